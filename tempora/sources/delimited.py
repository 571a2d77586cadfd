"""Delimited text: a profile is detected on the first lines and checked on all of them, and the file is read by it as a plan of Spark columns.

Lines are split by Spark's text reader and parsed as whole lines, so a table's rows don't depend on the
columns that are asked for. Where quotes hold line ends, the lines of a record are put together by the parity of
quotes: that of each split is counted first, and splits then know whether they begin within quotes.
"""

from __future__ import annotations

import csv
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .numbers import number, number_of
from .times import TimeAxis, detect_time, is_named_day, time_ms

#: Lines that detection looks at.
SAMPLE = 850
DELIMITERS = (",", ";", "\t", " ")
#: A whole cell with a date, a time of day, or both.
_DAY, _TIME = r"\d{1,4}[-/.]\d{1,2}([-/.]\d{1,4})?", r"\d{1,2}:\d{2}(:\d{2}([.,]\d+)?)?\s*([AaPp]\.?[Mm]\.?)?(Z|[+-]\d{2}:?\d{2})?"
_DATE = re.compile(rf"{_DAY}([T ]+{_TIME})?|{_TIME}")


#: Spark reads Latin-1; where windows-1252 differs from it, its characters are put in.
LATIN = "ISO-8859-1"
_DIFFERENT = [b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")]
_FROM, _TO = "".join(map(chr, _DIFFERENT)), bytes(_DIFFERENT).decode("cp1252")


@dataclass
class Profile:
    """How a file is to be read. ``skip`` counts lines (blank ones left out) before the first data row."""

    encoding: str
    delimiter: str
    skip: int
    names: list[str]
    units: list[str]
    numeric: list[bool]
    time: TimeAxis
    comma: bool = False
    ignored: tuple[str, ...] = field(default_factory=tuple)
    #: whether quotes hold line ends
    quoted: bool = False


@dataclass(frozen=True)
class Counts:
    """What a file has: rows of the table's width, lines of another one (headers among them), rows without a valid time, and cells of numeric columns that are no numbers."""

    rows: int
    other_width: int
    invalid_times: int
    invalid_cells: dict[str, int]


def _lines(spark: SparkSession, path: str, encoding: str, places: bool = False) -> DataFrame:
    """``line`` and ``_row``: the lines of a file, decoded, and their order. A byte-order mark is left out. With ``places``, the file and the byte its split begins at too."""
    raw = spark.read.text(path)
    at = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")] if places else []
    if encoding == LATIN:
        return raw.select(F.translate(F.decode(F.col("value").cast("binary"), LATIN), _FROM, _TO).alias("line"), F.monotonically_increasing_id().alias("_row"), *at)
    bare = F.when(F.startswith("value", F.lit("\ufeff")), F.substr("value", F.lit(2))).otherwise(F.col("value"))
    return raw.select(bare.alias("line"), F.monotonically_increasing_id().alias("_row"), *at)


def _quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def _records(lines: DataFrame) -> DataFrame:
    """Lines put together where a quote that is open at a line's end goes on in the next; files begin outside quotes.

    ``lines`` has their places. A task may read splits of several files, and those of a file aren't read in
    one row (Spark deals them by size), so each is known by its file and first byte.
    """
    found = lines.groupBy("_file", "_start").agg(F.sum(_quotes(F.col("line")) % 2).alias("odd")).collect()  # a row a split
    splits, file, open_, owner = [], None, False, -1
    for n, r in enumerate(sorted(found, key=lambda r: (r["_file"], r["_start"]))):
        if r["_file"] != file:
            file, open_, owner = r["_file"], False, -1
        splits.append((r["_file"], r["_start"], n, open_, owner))
        if not (open_ and r.odd == 0):  # the record that is open at its end begins here
            owner = n
        open_ ^= r.odd % 2 == 1
    table = F.broadcast(lines.sparkSession.createDataFrame(splits, "_file string, _start long, _split int, _inside boolean, _before int"))
    numbered = lines.join(table, ["_file", "_start"]).select("line", "_row", "_split", "_inside", "_before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, at, within, owner = [], None, None, False, None
        for batch in batches:
            out = []
            for line, row, split, inside, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if split != at:
                    if held:  # open at the end: the splits that follow have the rest
                        out.append(("\n".join(held), first, at, at if owner is None else owner))
                    held, at, within, owner = [], split, inside, before if inside else None
                first = row if not held else first
                held.append(line)
                within ^= line.count('"') % 2 == 1
                if not within:
                    out.append(("\n".join(held), first, at, owner))
                    held, owner = [], None
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], [], []), kinds, strict=True)], names)
        if held:
            last = ("\n".join(held), first, at, at if owner is None else owner)
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(last, kinds, strict=True)], names)

    kinds, names = (pa.string(), pa.int64(), pa.int32(), pa.int32()), ["line", "_row", "_split", "_owner"]
    got = numbered.mapInArrow(run, "line string, _row long, _split int, _owner int")
    # a part or two of each split
    parts = got.filter("_owner is not null").groupBy("_owner").agg(F.array_sort(F.collect_list(F.struct("_split", "_row", "line"))).alias("p"))
    joined = parts.select(F.array_join(F.col("p.line"), "\n").alias("line"), F.col("p")[0]["_row"].alias("_row"))
    return got.filter("_owner is null").select("line", "_row").unionByName(joined)


def tokens(line: str, delimiter: str) -> list[str]:
    if delimiter == " ":
        return line.split()
    return next(csv.reader(line.splitlines(keepends=True), delimiter=delimiter), [])


def joined(lines: list[str]) -> list[str]:
    """The records of some lines: one that ends within quotes goes on in the next, if the quotes close at all."""
    out, held = [], []
    for line in lines:
        held.append(line)
        if sum(x.count('"') for x in held) % 2 == 0:
            out.append("\n".join(held))
            held = []
    return out + held


def _value_like(cell: str, comma: bool) -> bool:
    return number(cell, comma) is not None or bool(_DATE.fullmatch(cell.strip())) or is_named_day(cell)


def _table(rows: list[list[str]], comma: bool) -> tuple[float, int, int, int]:
    """Score, width, first data row and header row (-1: none) of the best table among the rows."""
    width, _ = Counter(len(r) for r in rows if len(r) > 1).most_common(1)[0] if any(len(r) > 1 for r in rows) else (1, 0)
    filled = [[c for c in r if c.strip()] for r in rows]
    least = min(2, width)
    data = [len(r) == width and sum(_value_like(c, comma) for c in f) >= max(least, (len(f) + 1) // 2) for r, f in zip(rows, filled, strict=True)]
    first = next((i for i, d in enumerate(data) if d and (i + 1 == len(data) or data[i + 1] or i + 2 < len(data) and data[i + 2])), len(rows))
    named = [i for i in range(first) if len(rows[i]) == width and all(number(c, comma) is None for c in rows[i]) and filled[i]]
    # of two rows of names, the one above has the names, and the lower one the units
    header = named[-2] if len(named) > 1 and named[-1] == named[-2] + 1 and _units(rows[named[-1]]) else named[-1] if named else -1
    skipped = first - header - 1 if header >= 0 else 0
    return 20 * sum(data) + 4 * width + 25 * (header >= 0) - 0.5 * max(header, 0) - 2 * skipped, width, first, header


def _units(row: list[str]) -> bool:
    return row[0].lstrip().startswith("#") or all(len(c.strip()) <= 8 and re.fullmatch(r"[\[(]?[^\s]*[\])]?", c.strip()) for c in row) and any(re.search(r"[/\[(°%]", c) for c in row)


def name_and_unit(head: str) -> tuple[str, str]:
    """``Name [unit]``, with any brackets, or ``Name / unit`` as its two parts."""
    head = head.strip()
    for opens, closes in ("[]", "()", "{}", "<>"):
        name, found, rest = head.removesuffix(closes).rpartition(opens)
        if head.endswith(closes) and found and name.strip() and closes not in rest:
            return name.strip(), rest.strip()
    name, found, unit = head.rpartition(" / ")
    return (name.strip(), unit.strip()) if found and name.strip() and unit.strip() else (head, "")


def _unique(names: list[str]) -> list[str]:
    seen: Counter[str] = Counter()
    taken = {n.lower() for n in names}
    out = []
    for n in names:
        seen[n.lower()] += 1
        k = n
        while seen[n.lower()] > 1 and k.lower() in taken:
            k = f"{n}_{seen[n.lower()]}"
            seen[n.lower()] += k.lower() in taken
        taken.add(k.lower())
        out.append(k)
    return out


def detect(spark: SparkSession, path: str, sample: int = SAMPLE, prefer: str = "DMY", encoding: str | None = None) -> Profile:
    """The profile of a file from its first ``sample`` lines; nothing else is read."""
    lines = [r.line or "" for r in _lines(spark, path, encoding or "UTF-8").limit(sample).collect()]
    if encoding is None:
        encoding = "UTF-8"
        if any("\ufffd" in x for x in lines):
            return detect(spark, path, sample, prefer, LATIN)
    if not lines:
        return Profile(encoding, ",", 0, [], [], [], TimeAxis("index"))
    best, records = None, joined(lines)
    for delimiter in DELIMITERS:
        rows = [tokens(x, delimiter) for x in (lines if delimiter == " " else records)[:250]]
        comma = delimiter != ","
        score, width, first, header = _table(rows, comma)
        follow = sum(len(r) == width for r in rows[first : first + 50])
        score += 25 * width + 12 * follow - 0.25 * max(header, 0) - (0 if width > 1 else 10_000)
        if best is None or score > best[0]:
            best = (score, delimiter, width, first, header, comma)
    _, delimiter, width, first, header, comma = best
    lines = lines if delimiter == " " else records
    rows = [r for r in (tokens(x, delimiter) for x in lines[first:]) if len(r) == width]
    comma = comma and any("," in c and number(c, True) is not None for r in rows[:200] for c in r)
    head = [c.lstrip("# ") if i == 0 else c for i, c in enumerate(tokens(lines[header], delimiter))] if header >= 0 else [f"column_{i + 1}" for i in range(width)]
    split = [name_and_unit(h) if h.strip() else (f"column_{i + 1}", "") for i, h in enumerate(head)]
    units = [u for _, u in split]
    if 0 <= header < first - 1 and len(below := tokens(lines[header + 1], delimiter)) == width:
        units = [u or b.strip("#[]() ") for u, b in zip(units, below, strict=True)]
    names = _unique([n for n, _ in split])
    numeric = []
    for k in range(width):
        cells = [r[k].strip() for r in rows if r[k].strip()]
        good = [x for c in cells if (x := number(c, comma)) is not None and x == x and abs(x) != float("inf")]
        numeric.append(not cells or len(good) > 0.5 * len(cells))
    return Profile(encoding, delimiter, first, names, units, numeric, detect_time(names, rows[:600], comma, prefer), comma)


def inspect(spark: SparkSession, path: str, profile: Profile | None = None, sample: int = SAMPLE, prefer: str = "DMY") -> tuple[Profile, Counts]:
    """The profile of a file, mended by what all its lines say, and what they count.

    Two passes of sums: one over the lines (text that is no UTF-8, quotes that hold line ends), one
    over the cells. A column is numeric if more than half of its cells are, and a decimal comma
    is known by any cell that only it makes a number. A profile that fits less than half of the lines is an error.
    """
    p = profile or detect(spark, path, sample, prefer)
    raw = spark.read.text(path)
    bad, odd = raw.agg(F.count_if(~F.is_valid_utf8("value")), F.count_if(_quotes(F.col("value")) % 2 == 1)).first()
    if bad and p.encoding != LATIN:
        p = detect(spark, path, sample, prefer, LATIN)
    if not p.names:
        return p, Counts(0, 0, 0, {})
    p = replace(p, quoted=bool(odd) and p.delimiter != " ")
    # what is asked of a row: does it fit, is it a header, has it no time; of each cell: is it filled, a finite number, one by a comma only
    asked = [F.col("_fits"), F.col("_head"), F.lit(False) if p.time.mode == "index" else time_ms(p.time, None, p.comma).isNull()]
    for n in p.names:
        c = F.col(f"`{n}`")
        with_comma = F.contains(c, F.lit(",")) & number_of(c, True).isNotNull() if p.delimiter != "," and not p.comma else F.lit(False)
        asked += [F.trim(c) != "", number_of(c, p.comma) * 0 == 0, with_comma]  # times zero is zero for finite numbers only
    # the answers are bits of a few longs, whose patterns are few: they are counted first, and then the bits
    groups = [asked[k : k + 60] for k in range(0, len(asked), 60)]
    masks = [sum((F.when(a, F.lit(1 << b)).otherwise(F.lit(0)).cast("long") for b, a in enumerate(g)), F.lit(0).cast("long")).alias(f"m{k}") for k, g in enumerate(groups)]
    patterns = _cells(spark, path, p).select(*masks).groupBy(*[f"m{k}" for k in range(len(groups))]).count()
    bit = lambda k: F.col(f"m{k // 60}").bitwiseAND(F.lit(1 << k % 60)) != 0
    data = bit(0) & ~bit(1)
    sums = [F.sum(F.when(data, F.col("count"))), F.sum(F.when(~bit(0), F.col("count")))]
    sums += [F.sum(F.when(data & bit(k), F.col("count"))) for k in range(2, len(asked))]
    got = [x or 0 for x in patterns.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
    invalid, got = got[2], got[:2] + got[3:]
    filled, finite, commas = (got[2 + k :: 3] for k in range(3))
    if got[1] > got[0] + 2 * p.skip:
        raise ValueError(f"{path}: {got[1]} lines have not the {len(p.names)} columns of its first lines")
    comma = p.comma or any(commas)
    good = [a + b for a, b in zip(finite, commas, strict=True)]
    numeric = [n == 0 or 2 * g > n for n, g in zip(filled, good, strict=True)]
    if comma != p.comma and p.time.mode == "numeric":  # its times are numbers too
        t = time_ms(p.time, None, comma)
        invalid = _cells(spark, path, replace(p, comma=comma)).filter(F.col("_fits") & ~F.col("_head") & t.isNull()).count()
    p = replace(p, comma=comma, numeric=numeric)
    lost = [n for n, f, g, is_number in zip(p.names, filled, good, numeric, strict=True) if is_number and f > g and n not in p.time.columns]
    wrong = {}
    if lost:  # infinite numbers and those that are none are told apart
        cells = [F.trim(F.col(f"`{n}`")) for n in lost]
        bad = _cells(spark, path, p).filter("_fits and not _head").agg(*[F.count_if((c != "") & number_of(c, comma).isNull()).alias(f"s{i}") for i, c in enumerate(cells)]).first()
        wrong = {n: k for n, k in zip(lost, bad, strict=True) if k}
    return p, Counts(got[0], got[1], invalid, wrong)


def row_filter(column: str, how: str, value: str = "", comma: bool = False) -> Column:
    """``==`` or ``!=`` of trimmed text, or ``is_numeric``."""
    c = F.trim(F.coalesce(F.col(f"`{column}`"), F.lit("")))
    if how == "is_numeric":
        x = number_of(c, comma)
        return F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))
    if how not in ("==", "!="):
        raise ValueError(f"no such row filter: {how}")
    return c == value.strip() if how == "==" else c != value.strip()


def _cells(spark: SparkSession, path: str, profile: Profile) -> DataFrame:
    """``_row``, the text columns, ``_fits`` (a line has the table's width) and ``_head`` (it is a header), for every line that is not blank."""
    p, width = profile, len(profile.names)
    lines = _lines(spark, path, p.encoding, places=p.quoted)
    lines = (_records(lines) if p.quoted else lines).filter(F.trim("line") != "")
    if p.delimiter == " ":
        cut = lines.select("_row", F.split(F.trim("line"), r"\s+", -1).alias("c"))
        out = cut.select("_row", *[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(p.names)], (F.size("c") == width).alias("_fits"))
    else:
        marked = ", ".join([*[f"c{i} string" for i in range(width)], "_corrupt string"])
        options = {"sep": p.delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
        cut = lines.select("_row", F.from_csv("line", marked, options).alias("c"))
        out = cut.select("_row", *[F.col(f"c.c{i}").alias(n) for i, n in enumerate(p.names)], F.col("c._corrupt").isNull().alias("_fits"))
    # headers are of text where most columns have numbers; each file of a folder may have its own
    kinds = [F.coalesce(F.trim(F.col(f"`{n}`")), F.lit("")) for n, is_number in zip(p.names, p.numeric, strict=True) if is_number]
    named = F.lit(bool(kinds))
    for c in reversed(kinds):  # a number in the first column settles it
        named = F.when((c == "") | number_of(c, p.comma).isNotNull(), F.lit(False)).otherwise(named)
    return out.withColumn("_head", named)


def text_rows(spark: SparkSession, path: str, profile: Profile) -> DataFrame:
    """The data rows as text columns, and ``_row``, whose order is that of the file; lines of another width and headers are left out."""
    return _cells(spark, path, profile).filter("_fits and not _head").drop("_fits", "_head")


def read_delimited(spark: SparkSession, path: str, profile: Profile | None = None, keep: Column | None = None) -> DataFrame:
    """``_row``, ``t`` and the columns of a file; numbers where the profile says so, else text. A column's metadata has its ``unit``.

    Without a ``profile``, one is detected and checked on the whole file (`inspect`).
    ``keep`` filters the rows of text. Rows without a valid time are left out (`inspect` counts them). Where the axis is a generated
    index, every row has its number, rows of empty cells too. Blank lines are no rows. An empty file gives no rows
    and the column ``t`` only.
    """
    p = profile or inspect(spark, path)[0]
    if not p.names:
        return spark.createDataFrame([], "_row long, t double")
    rows = text_rows(spark, path, p)
    if keep is not None:
        rows = rows.filter(keep)
    if p.time.mode == "index":
        rows = physical_number(rows, "_row")
    t = time_ms(p.time, F.col("_n") if p.time.mode == "index" else None, p.comma)
    made = []
    for n, is_number, unit in zip(p.names, p.numeric, p.units, strict=True):
        if n not in p.time.columns and n not in p.ignored:
            c = number_of(F.col(f"`{n}`"), p.comma) if is_number else F.col(f"`{n}`")
            made.append(c.alias(n, metadata={"unit": unit} if unit else {}))
    return rows.select("_row", t.alias("t"), *made).filter("t is not null")


def physical_number(df: DataFrame, row: str) -> DataFrame:
    """``df`` with ``_n``, the 0-based number of each row in physical order.

    The upper bits of a row's id are its partition's number, so partitions are counted first and windows run within one partition each.
    """
    from pyspark.sql import Window

    part = F.shiftright(F.col(row), 33)
    counts = df.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    start = counts.select("_part", F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(row)) - 1
    # one row a partition of the input: broadcast by its size, as Spark decides
    return df.withColumn("_part", part).withColumn("_own", own).join(start, "_part").withColumn("_n", F.col("_start") + F.col("_own")).drop("_part", "_own", "_start")


def column_kinds(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: constant (all values equal) and boolean (0 and 1, both present)."""
    found = F.array(*[
        F.struct(F.lit(c).alias("name"), (F.min(c) == F.max(c)).alias("constant"), (F.coalesce(F.bool_and(F.col(c).isin(0, 1)), F.lit(False)) & (F.min(c) == 0) & (F.max(c) == 1)).alias("boolean")) for c in columns
    ])
    return df.agg(found.alias("k")).select(F.explode("k").alias("k")).select("k.*")


def stalled(df: DataFrame, t: str = "t", row: str = "_row", rows: int = 1000) -> bool:
    """Whether three rows one after another of the first ``rows`` have one time."""
    times = [r[0] for r in df.select(t, row).orderBy(row).limit(rows).collect()]
    return any(a == b == c for a, b, c in zip(times, times[1:], times[2:], strict=False))


def in_time_order(df: DataFrame) -> DataFrame:
    """Rows by time, then by their place in the file."""
    return df.repartitionByRange("t", "_row").sortWithinPartitions("t", "_row")


def to_parquet(df: DataFrame, path: str) -> None:
    in_time_order(df).drop("_row").write.option("compression", "zstd").mode("overwrite").parquet(path)


def time_text(t: Column, millis: bool = True) -> Column:
    """ISO text of milliseconds since 1970, in a session whose zone is UTC."""
    return F.date_format(F.timestamp_millis(t.cast("long")), "yyyy-MM-dd HH:mm:ss" + (".SSS" if millis else ""))


def duration_text(ms: Column) -> Column:
    """``d hh:mm:ss.fff`` of milliseconds, with the sign in front."""
    whole = F.abs(F.round(ms)).cast("long")
    at = lambda unit, most: F.expr("0") + F.floor(whole / unit) % most
    sign = F.when(ms < 0, "-").otherwise("")
    return F.concat(sign, F.format_string("%d %02d:%02d:%02d.%03d", F.floor(whole / 86_400_000), at(3_600_000, 24), at(60_000, 60), at(1000, 60), whole % 1000))


def export(df: DataFrame, columns: list[str], path: str) -> None:
    """Series as delimited text with a header: time as text, then the columns (two or three coordinates of a trajectory among them)."""
    df.select(time_text(F.col("t")).alias("time"), *columns).write.mode("overwrite").option("header", True).csv(path)
