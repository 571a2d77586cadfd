"""Delimited text: detection, numbers, times in all forms, filters, and the way to Parquet."""

import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tempora.sources import delimited, numbers, open_table, times


def ms(*a):
    return datetime(*a, tzinfo=UTC).timestamp() * 1000


def written(tmp_path, text, encoding="utf-8"):
    path = tmp_path / "x.csv"
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.mark.parametrize(
    "mode,how,cells",
    [
        ("iso", {}, {"2024-02-29": ms(2024, 2, 29), "2023-02-29": None, "2024-01-02T03:04:05.5+01:00": ms(2024, 1, 2, 2, 4, 5, 500_000), "2024-01-02 03:04": ms(2024, 1, 2, 3, 4), "x": None}),
        ("slash", {}, {"31/12/2020 23:59": ms(2020, 12, 31, 23, 59), "1/2/69": ms(2069, 2, 1), "1/2/70": ms(1970, 2, 1), "13/13/2020": None}),
        ("slash", {"order": "MDY"}, {"12/31/2020 12:05 AM": ms(2020, 12, 31, 0, 5), "12/31/2020 12:05 PM": ms(2020, 12, 31, 12, 5), "1/2/2020 13:00 PM": None}),
        ("dash", {}, {"31.12.2020": ms(2020, 12, 31), "31-12-2020 01:02:03": ms(2020, 12, 31, 1, 2, 3)}),
        ("year_month", {}, {"2020-11": ms(2020, 11, 1), "2020-13": None}),
        ("yearless", {"order": "MDY"}, {"2/3 4:05": ms(2001, 2, 3, 4, 5)}),
        ("yearless", {}, {"2/3 4:05": ms(2001, 3, 2, 4, 5), "28-12 08:30": ms(2001, 12, 28, 8, 30)}),
        ("month_name", {}, {"Jan 1 2000": ms(2000, 1, 1), "3 août 2021 10:30": ms(2021, 8, 3, 10, 30), "15 marzo 2020": ms(2020, 3, 15), "März 2019": ms(2019, 3, 1), "foo 2019": None}),
        ("excel", {}, {"25569": 0.0, "25570.5": 1.5 * 86_400_000}),
        ("matlab", {}, {"719529": 0.0}),
        ("decimal_year", {}, {"2020.5": ms(2020, 7, 2)}),
        ("numeric", {}, {" 1 000.5 ": 1000.5, "1D3": 1000.0, "inf": None, "": None}),
        ("pattern", {"pattern": "yyyyMMdd:HHmm"}, {"20200131:2359": ms(2020, 1, 31, 23, 59), "20200231:0000": None}),
        ("pattern", {"pattern": "d MMMM yy h:mm AM/PM"}, {"5 junho 21 1:30 PM": ms(2021, 6, 5, 13, 30)}),
    ],
)
def test_times(spark, mode, how, cells):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = [r.t for r in rows.select("i", times.time_ms(times.TimeAxis(mode, ("c",), **how)).alias("t")).orderBy("i").collect()]
    assert got == list(cells.values())


def test_times_of_two_and_more_columns(spark):
    rows = spark.createDataFrame([("31/12/2020", "7:05", "2020", "Dec", "31"), ("31/12/2020", "7", "2020", "2", "30")], "d string, h string, y string, m string, n string")
    split = times.time_ms(times.TimeAxis("split", ("d", "h"), pattern="slash"))
    parts = times.time_ms(times.TimeAxis("parts", ("y", "m", "n")))
    assert [tuple(r) for r in rows.select(split.alias("a"), parts.alias("b")).collect()] == [(ms(2020, 12, 31, 7, 5), ms(2020, 12, 31)), (None, None)]


@pytest.mark.parametrize(
    "names,row,mode",
    [
        (["when", "v"], ["2024-01-0{i}", "{i}"], "iso"), (["Month", "v"], ["2024-0{i}", "{i}"], "year_month"), (["v", "date"], ["{i}", "1{i}/03/2020"], "slash"), (["a", "v"], ["Jan {i} 2000", "3"], "month_name"),
        (["time_s", "v"], ["{i}", "3"], "numeric"), (["n", "v"], ["{i}", "3"], "index"), (["date", "time", "v"], ["2020-01-0{i}", "10:0{i}", "1"], "split"), (["date", "v"], ["4000{i}", "1"], "excel"),
        (["x", "v"], ["73000{i}", "1"], "matlab"), (["year", "v"], ["2000.{i}", "1"], "decimal_year"), (["sample index", "v"], ["{i}", "1"], "index"),
    ],
)
def test_detection_of_the_axis(names, row, mode):
    rows = [[c.replace("{i}", str(i)) for c in row] for i in range(1, 9)]
    assert times.detect_time(names, rows).mode == mode


def test_numbers_in_cells_and_columns_agree(spark):
    cells = ["1", " -2.5 ", "1 234", "1,5", "1.5D+03", ".19", "inf", "-Inf", "nan", "", "x", "1e", "1.2.3", "0x1"]
    for comma in (False, True):
        df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
        got = [r.x for r in df.select("i", numbers.number_of(F.col("c"), comma).alias("x")).orderBy("i").collect()]
        assert list(map(str, got)) == [str(numbers.number(c, comma)) for c in cells]
    assert numbers.number("1,5", True) == 1.5 and numbers.number("1,5") is None


def test_file_with_preamble_units_decimal_comma_and_wrong_rows(spark, tmp_path):
    text = "Station é €\n\nHorodatage;Puissance (kW);Nom;Nom\n2020-01-02 00:00;1,5;a;b\n2020-01-01 00:00;2,5;\"c;d\";e\nbroken;1\n2020-01-03 00:00;;x;5 €\n"
    path = written(tmp_path, text, "cp1252")
    p = delimited.detect(spark, path)
    assert (p.encoding, p.delimiter, p.names, p.units[1], p.comma, p.time.mode) == ("ISO-8859-1", ";", ["Horodatage", "Puissance", "Nom", "Nom_2"], "kW", True, "iso")
    rows = [tuple(r)[1:] for r in delimited.in_time_order(delimited.read_delimited(spark, path, p)).collect()]
    assert rows == [(ms(2020, 1, 1), 2.5, "c;d", "e"), (ms(2020, 1, 2), 1.5, "a", "b"), (ms(2020, 1, 3), None, "x", "5 €")]
    some = delimited.read_delimited(spark, path, p, keep=delimited.row_filter("Nom", "!=", "a"))
    assert some.count() == 2
    assert delimited.read_delimited(spark, path, p, keep=delimited.row_filter("Puissance", "is_numeric", comma=True)).count() == 2


def test_index_whitespace_and_empty_files(spark, tmp_path):
    path = written(tmp_path, "  1   2.0\n 3  4.0\n  3 x\n 5\t6.0\n")
    rows = [tuple(r)[1:] for r in delimited.in_time_order(open_table(spark, path)).collect()]
    assert [r[0] for r in rows] == [0.0, 1.0, 2.0, 3.0] and rows[3][1:] == (5.0, 6.0)
    assert open_table(spark, written(tmp_path, "")).count() == 0
    with pytest.raises(ValueError):
        open_table(spark, "a.mat")


def test_round_trip_to_parquet_and_text(spark, tmp_path):
    path = written(tmp_path, "time,v,flag\n" + "".join(f"2020-01-0{1 + i % 9} 00:00:00,{i},{i % 2}\n" for i in range(40)))
    df = open_table(spark, path)
    assert {r.name: (r.constant, r.boolean) for r in delimited.column_kinds(df, ["v", "flag"]).collect()} == {"v": (False, False), "flag": (False, True)}
    assert not delimited.stalled(df) and delimited.stalled(df.withColumn("t", F.lit(1.0)))
    delimited.to_parquet(df, f"{tmp_path}/p")
    back = spark.read.parquet(f"{tmp_path}/p")
    assert [r.t for r in back.collect()] == sorted(r.t for r in df.collect()) and back.columns == ["t", "v", "flag"]
    delimited.export(df, ["v"], f"{tmp_path}/out.csv")
    again = open_table(spark, f"{tmp_path}/out.csv")
    assert sorted((r.t, r.v) for r in again.collect()) == sorted((r.t, r.v) for r in df.collect())
    one = spark.range(1).select(delimited.duration_text(F.lit(-90_061_001.0)).alias("d"), delimited.time_text(F.lit(0.0)).alias("t")).first()
    assert tuple(one) == ("-1 01:01:01.001", "1970-01-01 00:00:00.000")


def many(tmp_path, line, n=2000, encoding="utf-8"):
    path = tmp_path / "many.csv"
    path.write_bytes(b"".join(line(i).encode(encoding if i > 1500 else "ascii") + b"\n" for i in range(-1, n)))
    return str(path)


def test_latin_text_behind_the_sample(spark, tmp_path):
    path = many(tmp_path, lambda i: "time,v,name" if i < 0 else f"2024-01-01 {i // 60:02d}:{i % 60:02d},{i},{'café' if i > 1500 else 'tea'}", 1439)
    path = many(tmp_path, lambda i: "n,v,name" if i < 0 else f"{i},{i},{'café €' if i > 1500 else 'tea'}", encoding="cp1252")
    names = {r.name for r in open_table(spark, path).select("name").distinct().collect()}
    assert names == {"café €", "tea"}


def test_decimal_commas_and_text_behind_the_sample(spark, tmp_path):
    path = many(tmp_path, lambda i: "n;v;w" if i < 0 else f"{i};{f'{i},5' if i >= 1200 else i};{'x' if i > 900 else 1}")
    df = open_table(spark, path)
    assert df.filter("v is null").count() == 0 and df.filter("v = 1999.5").count() == 1
    assert dict(df.dtypes)["w"] == "string"  # most of its cells are text
    p, counts = delimited.inspect(spark, many(tmp_path, lambda i: "n;v" if i < 0 else f"{i};{'bad' if i == 1900 else i}"))
    assert counts == delimited.Counts(2000, 0, 0, {"v": 1}) and p.numeric == [True, True]


def test_rows_do_not_depend_on_columns(spark, tmp_path):
    lines = ["time,a,b", *[f"2024-01-01 00:{i % 60:02d}:{i // 60:02d},{i},{i}" for i in range(200)]]
    lines[50] += ",9"
    lines[150] = "2024-01-01 00:01:01,7"
    path = written(tmp_path, "\n".join(lines))
    df = open_table(spark, path)
    assert len(df.collect()) == df.count() == df.select("a").count() == len(df.select("b").collect()) == len(df.select("t").collect()) == 198
    assert delimited.inspect(spark, path)[1].other_width == 2


def test_few_odd_rows_leave_the_delimiter(spark, tmp_path):
    lines = ["time,a,b", *[f"2024-01-01 00:{i:02d},{i},{2 * i}" for i in range(28)], "2024-01-01 00:40,1", "2024-01-01 00:41,1,2,3"]
    df = open_table(spark, written(tmp_path, "\n".join(lines)))
    assert df.columns == ["_row", "t", "a", "b"] and df.count() == 28


def test_blank_rows_of_an_index_keep_their_number(spark, tmp_path):
    lines = ["v,w", *["," if i == 7 else f"{i},{i}" for i in range(20)]]
    rows = open_table(spark, written(tmp_path, "\n".join(lines))).orderBy("t").collect()
    assert [r.t for r in rows] == [*range(20)] and rows[7].v is None and all(r.v == r.t for r in rows if r.t != 7)


def test_order_of_yearless_dates(spark, tmp_path):
    lines = ["date,v", *[f"{d}/12 08:30,{d}" for d in range(1, 29)]]
    rows = open_table(spark, written(tmp_path, "\n".join(lines))).collect()
    assert [r.t for r in rows] == [ms(2001, 12, d, 8, 30) for d in range(1, 29)]
    assert times.detect_time(["ora", "v"], [[f"{i}", "1"] for i in range(9)]).mode == "numeric"
    assert times.detect_time(["time row", "v"], [[f"{i}", "1"] for i in range(9)]).mode == "index"


@pytest.mark.parametrize("head", ["speed [m/s]", "speed (m/s)", "speed {m/s}", "speed <m/s>", "speed / m/s"])
def test_units_travel_with_columns(spark, tmp_path, head):
    df = open_table(spark, written(tmp_path, f"time,{head},b\n" + "".join(f"2024-01-0{i},{i},{i}\n" for i in range(1, 6))))
    assert df.schema["speed"].metadata == {"unit": "m/s"} and df.schema["b"].metadata == {}
    assert df.filter("speed > 2").orderBy("t").select("speed").schema["speed"].metadata == {"unit": "m/s"}


@pytest.mark.parametrize("split", [40, 97, 1 << 20])
def test_quoted_line_ends_in_splits(spark, tmp_path, split):
    """Splits may begin within quotes, and lie in them as a whole."""
    rng, lines, want = random.Random(3), ["t,v,note"], []
    for i in range(60):
        note = "".join(rng.choice(["a", " ", ",", "\n", '""', "\n\n"]) for _ in range(rng.choice((0, 2, 9, 120 if i % 20 == 7 else 1))))
        lines.append(f'{i},{i * 2},"{note}x"')
        want.append((i, i * 2, note.replace('""', '"') + "x"))
    path = written(tmp_path, "\n".join(lines) + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = open_table(spark, path)
        rows = df.orderBy("_row").collect()
        assert [(r.t, r.v, r.note) for r in rows] == want and df.count() == 60
    finally:
        for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.set(k, before[k]) if k in before else spark.conf.unset(k)


def test_quoted_line_ends_in_splits_of_several_files(spark, tmp_path):
    """Whole splits of all files are dealt before the last ones, and a task may read parts of several files."""
    rng, want = random.Random(5), []
    (tmp_path / "many").mkdir()
    for f in range(3):
        lines = ["t,v,note"]
        for i in range(40 * f, 40 * f + 40):
            note = "".join(rng.choice(["a", ",", "\n", '""']) for _ in range(rng.choice((0, 3, 11, 90 if i % 13 == 7 else 1))))
            lines.append(f'{i},{i * 2},"{note}x\n{i}"')
            want.append((i, i * 2, note.replace('""', '"') + f"x\n{i}"))
        (tmp_path / "many" / f"{f}.csv").write_text("\n".join(lines) + "\n")
    sizes = {"spark.sql.files.maxPartitionBytes": "211", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k, None) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        df = delimited.read_delimited(spark, str(tmp_path / "many"))
        assert [(r.t, r.v, r.note) for r in df.orderBy("t").collect()] == want
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_profile_that_does_not_fit(spark, tmp_path):
    path = many(tmp_path, lambda i: "t,v" if i < 0 else f"{i},{i}" if i < 900 else f"{i},{i},{i},x")
    with pytest.raises(ValueError):
        delimited.inspect(spark, path)
