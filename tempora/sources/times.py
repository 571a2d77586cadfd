"""Time in text: which columns of a sample hold it, and its milliseconds since 1970 as a column."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.exprs import DAY
from .numbers import number, number_of

#: Names of the months in English, French, Spanish, Italian, Portuguese and German, without accents (fixed values).
MONTHS = """
january february march april may june july august september october november december
janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre
enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre
gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre
janeiro fevereiro marco abril maio junho julho agosto setembro outubro novembro dezembro
januar februar marz april mai juni juli august september oktober november dezember
"""
#: What a header's words say for a time axis (fixed values), and words that say against it.
KEYWORDS = {"datetime": 1.0, "timestamp": 1.0, "horodatage": 1.0, "date": 0.85, "fecha": 0.85, "data": 0.85, "datum": 0.85, "time": 0.85, "temps": 0.85, "tiempo": 0.85, "zeit": 0.85, "heure": 0.85, "horaire": 0.85, "hora": 0.85, "ora": 0.85, "orario": 0.85, "day": 0.55, "jour": 0.55, "dia": 0.55}
AGAINST = {"index", "idx", "id", "row", "sample", "n", "no", "week", "count", "number", "std", "avg", "mean"}
CLOCK_WORDS = {"time", "temps", "tiempo", "zeit", "heure", "horaire", "hora", "ora", "orario", "t", "elapsed", "seconds"}
LEAST_SCORE = 0.30

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2}(?:[.,]\d+)?))?\s*([AaPp]\.?[Mm]\.?)?"
PATTERNS = {
    "iso": r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ]+" + _CLOCK + r")?\s*(Z|[+-]\d{2}:?\d{2})?$",
    "year_month": r"^(\d{4})[-/](\d{1,2})$",
    "slash": r"^(\d{1,4})/(\d{1,2})/(\d{1,4})(?:[T ,]+" + _CLOCK + r")?$",
    "dash": r"^(\d{1,4})[-.](\d{1,2})[-.](\d{1,4})(?:[T ,]+" + _CLOCK + r")?$",
    "yearless": r"^(\d{1,2})[-/](\d{1,2})\s+" + _CLOCK + r"$",
    "clock": r"^" + _CLOCK + r"$",
}


def plain(s: str) -> str:
    """Small letters without accents; other than letters and digits are spaces."""
    s = unicodedata.normalize("NFKD", s.lower())
    return " ".join(re.sub(r"[^a-z0-9]+", " ", "".join(c for c in s if not unicodedata.combining(c))).split())


@cache
def month_numbers() -> dict[str, int]:
    """Every beginning of three letters or more of a month's name that means one month only."""
    meant: dict[str, set[int]] = {}
    for line in MONTHS.strip().splitlines():
        for i, name in enumerate(line.split(), 1):
            for n in range(3, len(name) + 1):
                meant.setdefault(name[:n], set()).add(i)
    return {k: min(v) for k, v in meant.items() if len(v) == 1}


@dataclass(frozen=True)
class TimeAxis:
    """How time is written: a mode, its columns, and the order of day, month and year or a pattern."""

    mode: str
    columns: tuple[str, ...] = ()
    order: str = "DMY"
    pattern: str = ""
    score: float = 0.0
    ambiguous: bool = False


def _month_name(cell: str, months: dict[str, int]) -> bool:
    return any(w in months for w in re.findall(r"[a-z]+", plain(cell))) and bool(re.search(r"\d", cell))


def is_named_day(cell: str) -> bool:
    """Whether a short cell is a day with its month's name: numbers, a month and a time of day, and no other words."""
    words = re.findall(r"[a-z]+", plain(cell))
    return 0 < len(words) <= 3 and len(cell) <= 40 and _month_name(cell, month_numbers()) and all(w in month_numbers() or w in ("am", "pm", "de", "del", "di", "t", "z") for w in words)


def _share(cells: list[str], test) -> float:
    return sum(map(bool, map(test, cells))) / len(cells)


def _order(cells: list[str], mode: str, prefer: str) -> tuple[str, bool]:
    got = [m for c in cells if (m := re.match(PATTERNS[mode], c))]
    if mode != "yearless" and any(len(m[1]) == 4 for m in got):
        return "YMD", False
    if any(int(m[1]) > 12 for m in got):
        return "DMY", False
    if any(int(m[2]) > 12 for m in got):
        return "MDY", False
    return prefer, True


def detect_time(names: list[str], rows: list[list[str]], comma: bool = False, prefer: str = "DMY") -> TimeAxis:
    """The best time axis of a sample; ``index`` (a generated one) if no score reaches 0.30."""
    months, found, dates, clocks = month_numbers(), [], {}, {}
    for k, name in enumerate(names):
        cells = [r[k].strip() for r in rows if k < len(r) and r[k].strip()]
        if not cells:
            continue
        words = plain(name).split()
        head = max([KEYWORDS.get(w, 0.0) for w in words] + [0.45 if words == ["t"] else 0.0])
        against = bool(AGAINST & set(words))
        clocked = 0.1 * (_share(cells, lambda c: ":" in c) >= 0.8)
        add = lambda score, mode, **how: found.append(TimeAxis(mode, (name,), score=min(1.0, score), **how))  # noqa: B023, E731
        share = {m: _share(cells, re.compile(p).match) for m, p in PATTERNS.items()}
        if share["iso"] >= 0.8:
            add(0.5 * head + 0.6 + clocked, "iso")
        if share["year_month"] >= 0.8:
            add(0.5 * head + 0.58, "year_month")
        for mode, base in (("slash", 0.55), ("dash", 0.5)):
            if share[mode] >= 0.8 and (mode == "slash" or share["iso"] < 0.5):
                order, ambiguous = _order(cells, mode, prefer)
                add(0.5 * head + base + clocked, mode, order=order, ambiguous=ambiguous)
        if share["yearless"] >= 0.8:
            order, ambiguous = _order(cells, "yearless", prefer)
            add(0.5 * head + 0.6, "yearless", order=order, ambiguous=ambiguous)
        if _share(cells, lambda c: _month_name(c, months)) >= 0.8:
            add(0.5 * head + 0.6 + clocked, "month_name")
        if share["clock"] >= 0.8:
            clocks[k] = share["clock"]
        day_only = max((share[m], m) for m in ("iso", "slash", "dash")) if not clocked else (0.0, "")
        if day_only[0] >= 0.8:
            dates[k] = day_only
        x = [number(c, comma) for c in cells]
        good = [v for v in x if v is not None and abs(v) != float("inf") and v == v]
        if len(good) < 0.95 * len(cells) or against:
            continue
        steps = [b - a for a, b in zip(good, good[1:], strict=False)]
        rising = sum(d > 0 for d in steps) / len(steps) if steps else 0.0
        middle = sorted(steps)[len(steps) // 2] if steps else 0.0
        if all(1800 <= v <= 2200 for v in good) and sum(v % 1 != 0 for v in good) >= 0.5 * len(good) and rising >= 0.75 and 1 / 500 < middle <= 1.25:
            add(0.72 + 0.18 * rising + 0.08 * head, "decimal_year")
        elif all(500_000 <= v <= 900_000 for v in good) and rising >= 0.75:
            add(0.86 + 0.14 * rising + 0.08 * head, "matlab")
        elif all(1 <= v <= 80_000 for v in good) and set(words) & {"date", "datetime", "fecha", "datum"}:
            add(0.7 * head + 0.25, "excel")
        if set(words) & CLOCK_WORDS:
            add(0.55 + 0.4 * head + (0.25 if rising >= 0.95 else 0.1 if rising >= 0.7 else 0.0), "numeric")
    for d, (share_d, mode) in dates.items():
        for c, share_c in clocks.items():
            words = set(plain(names[d]).split()), set(plain(names[c]).split())
            score = 0.45 + 0.2 * bool(words[0] & set(KEYWORDS)) + 0.2 * bool(words[1] & CLOCK_WORDS) + 0.1 * (abs(c - d) == 1) + 0.1 * (min(share_d, share_c) >= 0.98)
            order, ambiguous = _order([r[d].strip() for r in rows if d < len(r)], mode, prefer) if mode != "iso" else ("YMD", False)
            found.append(TimeAxis("split", (names[d], names[c]), order=order, pattern=mode, score=min(1.0, score), ambiguous=ambiguous))
    splits = {c for a in found if a.mode == "split" and a.score >= 0.5 for c in a.columns}
    found = [a for a in found if a.mode == "split" or not set(a.columns) & splits]
    best = max(found, key=lambda a: a.score, default=TimeAxis("index"))
    return best if best.score >= LEAST_SCORE else TimeAxis("index")


def _part(c: Column, pattern: str, i: int) -> Column:
    got = F.regexp_extract(c, pattern, i)
    return F.when(got != "", got)


def _groups(c: Column, pattern: str, made) -> Column:
    """``made(part)``, where ``part(i)`` is the i-th group of an anchored pattern; null where it doesn't match.

    The pattern runs once a cell, and what is made of the groups is kept out of generated code, which it would outgrow.
    """
    n = re.compile(pattern.replace("\\p{L}", "\\w")).groups
    cells = F.split(F.regexp_replace(c, pattern, "\u0001".join(f"${i}" for i in range(1, n + 1))), "\u0001", -1)
    return F.element_at(F.transform(F.array(cells), lambda g: F.when((F.size(g) == n) & c.rlike(pattern), made(lambda i: F.nullif(F.get(g, F.lit(i - 1)), F.lit(""))))), 1)


def _year(y: Column) -> Column:
    n = y.try_cast("int")
    return F.when(F.length(y) <= 2, F.when(n < 70, n + 2000).otherwise(n + 1900)).otherwise(n)


def _clock_ms(part, first: int) -> Column:
    """Milliseconds of the day of a clock time whose groups begin at ``first``; 0 without one, null if it is none."""
    h, m, s, half = (part(first + k) for k in range(4))
    hour = h.try_cast("int")
    afternoon = F.lower(F.substring(half, 1, 1)) == "p"
    hour = F.when(half.isNull(), hour).when(hour > 12, None).otherwise(hour % 12 + F.when(afternoon, 12).otherwise(0))
    second = F.coalesce(F.regexp_replace(s, ",", ".").try_cast("double"), F.lit(0.0))
    ok = (hour < 24) & (m.try_cast("int") < 60) & (second < 60)
    return F.when(h.isNull(), F.lit(0.0)).when(ok, (hour * 60 + m.try_cast("int")) * 60_000.0 + second * 1000)


def _day_ms(y: Column, m: Column, d: Column) -> Column:
    """Milliseconds at the start of a day; null where the calendar has no such day."""
    month = F.when(m.between(1, 12), m)
    first = F.when(y.between(1, 9999), F.make_date(y, F.coalesce(month, F.lit(1)), F.lit(1)))
    return F.when(month.isNotNull() & d.between(1, F.day(F.last_day(first))), (F.unix_date(first) + d - 1).cast("double") * DAY)


def _date_ms(part, mode: str, order: str) -> Column:
    at = dict(zip("YMD" if mode == "iso" else order, (part(i) for i in (1, 2, 3)), strict=True))
    return _day_ms(_year(at["Y"]), at["M"].try_cast("int"), at["D"].try_cast("int"))


def _zone_ms(zone: Column) -> Column:
    """Milliseconds by which a zone such as +01:00 is ahead; 0 for Z and none."""
    bare = F.regexp_replace(F.coalesce(zone, F.lit("Z")), ":", "")
    minutes = F.substring(bare, 2, 2).try_cast("int") * 60 + F.substring(bare, 4, 2).try_cast("int")
    return F.when(bare == "Z", F.lit(0.0)).otherwise(F.when(F.substring(bare, 1, 1) == "-", -60_000.0).otherwise(60_000.0) * minutes)


_TOKENS = {"yyyy": (r"(\d{4})", "Y"), "yy": (r"(\d{2})", "Y"), "MMMM": (r"(\p{L}+)\.?", "N"), "MMM": (r"(\p{L}+)\.?", "N"), "MM": (r"(\d{2})", "M"), "M": (r"(\d{1,2})", "M"), "dd": (r"(\d{2})", "D"), "d": (r"(\d{1,2})", "D"), "HH": (r"(\d{2})", "h"), "H": (r"(\d{1,2})", "h"), "hh": (r"(\d{2})", "h"), "h": (r"(\d{1,2})", "h"), "mm": (r"(\d{2})", "m"), "m": (r"(\d{1,2})", "m"), "ss": (r"(\d{2})", "s"), "s": (r"(\d{1,2})", "s"), "SSS": (r"(\d{1,3})", "f"), "AM/PM": (r"([AaPp])\.?[Mm]\.?", "a")}


def _month_of(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in month_numbers().items() for x in kv])
    bare = F.translate(F.lower(name), "àâäáãéèêëíìîïóòôöõúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")
    return F.try_element_at(table, bare)


def _by_pattern(c: Column, pattern: str) -> Column:
    regex, meaning = "^", []
    for t in re.findall(r"yyyy|yy|MMMM|MMM|MM|M|dd|d|HH|H|hh|h|mm|m|SSS|ss|s|AM/PM|.", pattern):
        part, what = _TOKENS.get(t, (re.escape(t), ""))
        regex += part
        meaning += [what] if what else []

    def made(part) -> Column:
        got = {w: part(i) for i, w in enumerate(meaning, 1)}
        n = lambda w, other: got[w].try_cast("int") if w in got else F.lit(other)
        month = _month_of(got["N"]) if "N" in got else n("M", 1)
        hour = n("h", 0)
        if "a" in got:
            hour = hour % 12 + F.when(F.lower(got["a"]) == "p", 12).otherwise(0)
        day = _day_ms(_year(got["Y"]) if "Y" in got else F.lit(2001), month, n("D", 1))
        clock = (hour * 60 + n("m", 0)) * 60_000.0 + n("s", 0) * 1000 + n("f", 0)
        return F.when((hour < 24) & (n("m", 0) < 60) & (n("s", 0) < 60), day + clock)

    return _groups(c, regex + "$", made)


def time_ms(axis: TimeAxis, row: Column | None = None, comma: bool = False) -> Column:
    """Time as a double column: milliseconds since 1970 (UTC) of calendar modes, the number itself of ``numeric``, ``row`` of ``index``; null if invalid."""
    if axis.mode == "index":
        return row.cast("double")
    c = F.trim(F.col(f"`{axis.columns[0]}`"))
    if axis.mode == "iso":
        # yyyy-mm-dd hh:mm:ss is read by a cast, other forms by the pattern
        usual = (F.length(c) == 19) & (F.substring(c, 5, 1) == "-") & (F.substring(c, 8, 1) == "-") & (F.substring(c, 14, 1) == ":") & (F.substring(c, 17, 1) == ":")
        since = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.when(usual, c.try_cast("timestamp_ntz"))).cast("double")
        return F.coalesce(since, _groups(c, PATTERNS["iso"], lambda g: _date_ms(g, "iso", "YMD") + _clock_ms(g, 4) - _zone_ms(g(8))))
    if axis.mode in ("slash", "dash"):
        return _groups(c, PATTERNS[axis.mode], lambda g: _date_ms(g, axis.mode, axis.order) + _clock_ms(g, 4))
    if axis.mode == "year_month":
        return _groups(c, PATTERNS["year_month"], lambda g: _day_ms(g(1).try_cast("int"), g(2).try_cast("int"), F.lit(1)))
    if axis.mode == "yearless":
        day, month = (2, 1) if axis.order == "MDY" else (1, 2)
        return _groups(c, PATTERNS["yearless"], lambda g: _day_ms(F.lit(2001), g(month).try_cast("int"), g(day).try_cast("int")) + _clock_ms(g, 3))
    if axis.mode == "month_name":
        names = F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"(\p{L}{3,})"), F.lit(1)), _month_of), lambda m: m.isNotNull())
        clock = r"(?:^|[^\d:])" + _CLOCK
        days = F.regexp_replace(c, _CLOCK, " ")
        year = F.coalesce(_part(days, r"(?:^|\D)(\d{4})(?!\d)", 1), F.lit("2001")).try_cast("int")
        day = F.coalesce(_part(F.regexp_replace(days, r"\d{4}", " "), r"(?:^|\D)(\d{1,2})(?!\d)", 1), F.lit("1")).try_cast("int")
        return _day_ms(year, F.try_element_at(names, F.lit(1)), day) + _clock_ms(lambda i: _part(c, clock, i), 1)
    if axis.mode == "split":
        second = F.trim(F.col(f"`{axis.columns[1]}`"))
        day = _groups(c, PATTERNS[axis.pattern], lambda g: _date_ms(g, axis.pattern, axis.order))
        return day + _groups(second, PATTERNS["clock"], lambda g: _clock_ms(g, 1))
    if axis.mode == "pattern":
        return _by_pattern(c, axis.pattern)
    if axis.mode == "parts":  # columns of year, month, day, hour, minute and second, as many as there are
        given = [F.trim(F.col(f"`{x}`")) for x in axis.columns]
        n = [number_of(x) for x in given] + [F.lit(float(v)) for v in (0, 1, 1, 0, 0, 0)][len(given) :]
        month = F.coalesce(n[1].cast("int"), _month_of(given[1])) if len(given) > 1 else n[1].cast("int")
        ok = n[3].between(0, 23) & n[4].between(0, 59) & (n[5] >= 0) & (n[5] < 60)
        return F.when(ok, _day_ms(n[0].cast("int"), month, n[2].cast("int")) + (n[3] * 60 + n[4]) * 60_000.0 + n[5] * 1000)
    x = number_of(c, comma)
    x = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    if axis.mode == "excel":
        return F.round((x - 25569) * DAY)
    if axis.mode == "matlab":
        return F.round((x - 719529) * DAY)
    if axis.mode == "decimal_year":
        year = F.floor(x).cast("int")
        start = _day_ms(year, F.lit(1), F.lit(1))
        return F.round(start + (x - year) * (_day_ms(year + 1, F.lit(1), F.lit(1)) - start))
    return x
