"""Growing files, batches that must not be appended, live tables; and the rules of series that streams and cursors share."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tempora.functions.formula import compile_formula
from tempora.operators import intervals
from tempora.operators import series as ser
from tempora.plans import queries as _registered  # noqa: F401
from tempora.plans.registry import QUERIES
from tempora.streaming import live, tail


def points(spark, *rows):
    return spark.createDataFrame([(float(t), float(v)) for t, v in rows], "t double, v double")


def read_ranges(path, start, end, split):
    reader = tail.TailReader(str(path), "utf-8", split, 1 << 20)
    return [(r.file, r.offset, r.line) for part in reader.partitions(start, end) for b in reader.read(part) for r in map(lambda x: type("R", (), x), b.to_pylist())]


def test_only_complete_lines_are_planned(tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes(b"a,1\nb,2\nc")
    reader = tail.TailReader(str(path), "utf-8", 8, 1 << 20)
    assert reader.initialOffset() == {} and reader.latestOffset() == {str(path): 8}
    assert reader.partitions({}, {str(path): 8}) and reader.latestOffset() == {str(path): 8}
    path.write_bytes(b"a,1\nb,2\nc,3\n")
    assert reader.latestOffset() == {str(path): 12}
    path.write_bytes(b"a,1\n")
    with pytest.raises(ValueError):
        reader.latestOffset()
    path.unlink()
    with pytest.raises(ValueError):
        reader.latestOffset()


def test_batches_are_bounded_and_long_lines_whole(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "LOOK", 3)
    path = tmp_path / "x.csv"
    path.write_bytes(b"aa\nbb\n" + b"c" * 40 + b"\ndd\n")
    reader, seen = tail.TailReader(str(path), "utf-8", 4, 7), []
    reader.initialOffset()
    at = {}
    while (end := reader.latestOffset()) != at:
        seen.append([r["line"] for part in reader.partitions(at, end) for b in reader.read(part) for r in b.to_pylist()])
        at = end
    assert seen == [["aa", "bb"], ["c" * 40], ["dd"]]
    # a query that goes on from its checkpoint plans all that is there, and never goes back
    assert tail.TailReader(str(path), "utf-8", 4, 7).latestOffset() == at


@pytest.mark.parametrize("split", [1, 2, 3, 7, 1000])
def test_ranges_give_each_line_once(tmp_path, monkeypatch, split):
    monkeypatch.setattr(tail, "LOOK", 2)
    rng = random.Random(split)
    for name in ("b.csv", "a.csv", "_skipped", ".hidden"):
        (tmp_path / name).write_bytes(b"".join(bytes(rng.choices(b"xyz\r", k=rng.choice((0, 1, 2, 9)))) + b"\n" for _ in range(30)))
    end = {k: v for k, v in tail.sizes(str(tmp_path)).items()}
    assert [k.split("/")[-1] for k in sorted(end)] == ["a.csv", "b.csv"]
    got, want = read_ranges(tmp_path, {}, end, split), []
    for file in sorted(end):
        at = 0
        for line in open(file, "rb").read().split(b"\n")[:-1]:
            want.append((file, at, line.removesuffix(b"\r").decode()))
            at += len(line) + 1
    assert got == want
    cut = {file: sum(len(x) + 1 for x in open(file, "rb").read().split(b"\n")[:11]) for file in end}
    parts = read_ranges(tmp_path, {}, cut, split) + read_ranges(tmp_path, cut, end, split)
    assert sorted(parts) == sorted(want)


def test_several_files_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.dataSource.register(tail.TailSource)
    stream = lambda: spark.readStream.format("tail").option("path", f"file://{tmp_path}/in").option("splitBytes", 50).option("batchBytes", 400).load()
    want = []
    for day in range(2):  # the second query goes on from the checkpoint of the first
        for k in range(3):
            rows = [f"{day}-{k}-{i}" for i in range(40)]
            want += rows
            with (tmp_path / "in" / f"f{k}.txt").open("a") as f:
                f.write("\n".join(rows) + "\n")
        q = stream().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.line for r in out) == sorted(want) and len({r.file for r in out}) == 3


def test_a_growing_file_as_a_stream(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("1,10\n2,20\n3")
    spark.dataSource.register(tail.TailSource)
    table = live.LiveTable(points(spark, (0, 0)), f"file://{tmp_path}/live")

    def add(batch, i):
        parts = F.split("line", ",")
        table.append(batch.select(parts[0].cast("double").alias("t"), parts[1].cast("double").alias("v")), i)

    stream = spark.readStream.format("tail").option("path", str(path)).load().writeStream.foreachBatch(add).option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="200 milliseconds").start()
    try:
        stream.processAllAvailable()
        with path.open("a") as f:
            f.write(",30\n4,40\n")
        end = time.time() + 30
        while table.view().count() < 5 and time.time() < end:
            stream.processAllAvailable()
    finally:
        stream.stop()
    assert sorted(map(tuple, table.view().collect())) == [(0, 0), (1, 10), (2, 20), (3, 30), (4, 40)]


def test_batches_are_checked(spark, tmp_path):
    table = live.LiveTable(points(spark, (1, 1)), f"file://{tmp_path}/live", most_rows=4)
    assert table.append(points(spark, (2, 1), (3, 1), (float("nan"), 1)), 0) == 2
    assert table.append(points(spark, (2, 1), (3, 1)), 0) == 2  # the same batch again
    for bad in (points(spark, (3, 1)), points(spark, (4, 1), (4, 2)), points(spark, *[(t, 0) for t in range(4, 9)]), points(spark, (9, 1)).drop("v")):
        with pytest.raises(live.RejectedBatch):
            table.append(bad, 1)
    assert table.append(points(spark, (5, 1)).limit(0), 1) == 0
    assert table.view().count() == 3


def test_events_of_one_millisecond_are_appended(spark, tmp_path):
    at = [start + k for start in (1_704_067_200_000, 1_704_412_800_000, 1_705_017_600_000) for k in (0, 7, 7)] + [None]
    rows = [(i, t, float(i)) for i, t in enumerate(at)]
    df = spark.createDataFrame(rows, "event_id long, t long, value double").selectExpr("event_id", "timestamp_millis(t) as ts", "value")
    df.write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["live_append"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == [(t, v) for _, t, v in rows]
    table = live.LiveTable(points(spark, (1, 1)), f"file://{tmp_path}/live", repeats=True)
    assert table.append(points(spark, (2, 1), (2, 2)), 0) == 2
    with pytest.raises(live.RejectedBatch):  # batches are later than those before
        table.append(points(spark, (2, 3)), 1)


def test_limits_count_the_batch_itself(spark, tmp_path):
    table = live.LiveTable(points(spark, (0, 0)), f"file://{tmp_path}/live", most_bytes=100)
    with pytest.raises(live.RejectedBatch):
        table.append(spark.range(1, 5000).selectExpr("double(id) as t", "rand() as v"), 0)
    assert table.view().count() == 1 and not [p for p in (tmp_path / "live").iterdir() if p.name != "_log"]


def test_a_half_written_batch_is_invisible(spark, tmp_path):
    table = live.LiveTable(points(spark, (0, 0)), f"file://{tmp_path}/live")
    table.append(points(spark, (1, 1)), 0)
    points(spark, (2, 2)).write.parquet(f"{tmp_path}/live/batch-1-lost")
    assert table.view().count() == 2 and table.append(points(spark, (2, 5)), 1) == 1
    assert sorted(map(tuple, table.view().collect())) == [(0, 0), (1, 1), (2, 5)]


def test_an_append_reads_the_newest_commit_only(spark, tmp_path):
    table = live.LiveTable(points(spark, (0, 0)), f"file://{tmp_path}/live")
    for i in range(4):
        table.append(points(spark, (i + 1, i)), i)
    assert table.append(points(spark, (9, 9)), 1) == 1 and table.view().count() == 5  # repeated
    for name in ("batch-0", "batch-1", "batch-2"):  # data and commits of before are not needed to append
        for p in (tmp_path / "live").glob(f"{name}-*"):
            p.rename(p.with_name("away-" + p.name))
    for v in (1, 2, 3):
        (tmp_path / "live" / "_log" / f"{v:012d}.json").unlink()
    table.base = table.base.withColumn("v", F.raise_error(F.lit("the base is read")).cast("double"))
    assert table.append(points(spark, (5, 5)), 4) == 1
    assert (table.log.newest().total_rows, table.log.newest().last) == (5, 5.0)


def test_of_two_writers_one_wins(spark, tmp_path):
    table = live.LiveTable(points(spark, (0, 0)), f"file://{tmp_path}/live")
    table.append(points(spark, (1, 1)), 0)
    newest = table.log.newest()
    with pytest.raises(live.Conflict):
        table.log.add(live.Commit(newest.version, 7, "x", 1, 1, 2.0, 2, 2))
    assert table.log.newest() == newest
    (tmp_path / "live" / "_log" / "hint").unlink()  # the hint is only one
    assert table.log.newest() == newest


def zoomed(out):
    return sorted(map(tuple, out.collect()))


def test_a_zoom_reads_one_level(spark, tmp_path):
    wave = spark.range(40_000).selectExpr("double(id) as t", "sin(id / 500.0) * 10 as v")
    table = live.LiveTable(wave.filter("t < 10000"), f"file://{tmp_path}/live", envelopes=("v",), finest=4.0)
    for i in range(3):
        table.append(wave.filter(F.col("t").between(10_000 * (i + 1), 10_000 * (i + 2) - 1)), i)
    rows = {int(r.t): r.v for r in wave.collect()}

    def cells(lo, hi, width):
        found = {}
        for t in range(int(lo // width * width), int((hi // width + 1) * width)):
            if t in rows:
                found.setdefault(t // width, []).append(t)
        return sorted((ts[0], ts[-1], min(rows[t] for t in ts), max(rows[t] for t in ts)) for ts in found.values())

    out = table.zoom(5_000, 25_000, 200)  # 100 cells of 200 at least: 256
    assert zoomed(out) == cells(5_000, 25_000, 256) and 70 <= out.count() <= 101
    files = out.inputFiles()
    assert files and all("/level=6/" in f for f in files)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(cell,19)" in plan
    assert zoomed(table.overview(400)) == cells(0, 39_999, 256)
    assert zoomed(table.zoom(100, 300, 200)) == [(t, t, rows[t], rows[t]) for t in range(100, 301)]
    fine = zoomed(table.zoom(0, 300, 200))  # 301 samples are too many, cells of 4 too wide
    assert len(fine) == 100 and fine[0] == (0, 2, rows[0], rows[2])
    with pytest.raises(ValueError):
        live.LiveTable(wave, f"file://{tmp_path}/other").zoom(0, 1)


def test_a_zoom_of_more_rows_than_a_browser_holds(spark, tmp_path):
    n = live.MOST_ROWS + 100  # a row each half second from 2024-01-05 on, all of them appended
    spark.range(n).selectExpr("id as event_id", "timestamp_millis(1704412800000 + id * 500) as ts", "double(id) as value").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, QUERIES["envelope_zoom"](spark, str(tmp_path)).collect()))
    cells = {}
    for i in range(n):
        cells.setdefault((1_704_412_800_000 + i * 500) // 15_360_000, []).append(i)
    assert got == [(1_704_412_800_000 + c[0] * 500, 1_704_412_800_000 + c[-1] * 500, c[0], c[-1]) for k, c in sorted(cells.items()) if k <= 1_705_017_600_000 // 15_360_000]


def test_levels_of_odd_rows(spark, tmp_path):
    nan = float("nan")
    odd = points(spark, (-5, 1), (-0.5, nan), (3, 7)).unionByName(spark.createDataFrame([(nan, 1.0), (None, 2.0)], "t double, v double"))
    table = live.LiveTable(odd.limit(0), f"file://{tmp_path}/live", envelopes=("v",), finest=1.0)
    assert table.overview().count() == 0 and table.append(odd, 0) == 3
    assert zoomed(table.zoom(-5, 3, 1)) == [(-5, -0.5, 1, 1), (3, 3, 7, 7)]


def test_generated_index_goes_on(spark, tmp_path):
    table = live.LiveTable(points(spark, (0, 5), (1, 6)), f"file://{tmp_path}/live", generated=True)
    for i in range(2):
        table.append(spark.createDataFrame([(7.0 + i,), (8.0 + i,)], "v double").coalesce(1), i)
    assert sorted(map(tuple, table.view().collect())) == [(0, 5), (1, 6), (2, 7), (3, 8), (4, 8), (5, 9)]


def test_union_of_intervals(spark):
    rows = [(0, 2), (1, 3), (3, 4), (6, 7), (6, 7), (9, 9), (8, None), (5, 4)]
    df = spark.createDataFrame(rows, "a int, b int")
    for chunk in (2, 1000):
        assert sorted(map(tuple, intervals.interval_union(df, "a", "b", chunk).collect())) == [(0, 4), (6, 7), (9, 9)]
    assert intervals.interval_union(df.limit(0), "a", "b").count() == 0


def series_of(spark, rows):
    df = spark.createDataFrame([(i, i if t is None else t, v) for i, (t, v) in enumerate(rows)], "k int, ts int, v double")
    from tempora.operators.ordering import indexed

    return indexed(df.select(F.col("ts").cast("long").alias("t"), "v", "k"), "t", "k")


def test_plateaus(spark):
    s = series_of(spark, [(None, v) for v in (1.0, 2.0, 2.0, 1.0, -1.0)])
    assert [tuple(r) for r in ser.extremum(s, 3.5, forward=False).collect()] == [(2, 2.0)]
    assert not ser.extremum(s, 2, forward=False).collect()
    assert [tuple(r) for r in ser.extremum(s, 0.5).collect()] == [(1, 2.0)]


def test_runs_between_samples_of_equal_time_stay_apart(spark):
    s = series_of(spark, [(0, 1.0), (1, 1.0), (1, None), (1, 1.0), (1, None), (1, 1.0)])
    assert [tuple(r) for r in ser.nan_runs(s).collect()] == [(1, 1, 1), (1, 1, 1)]


def test_many_divisions_make_a_small_plan(spark):
    start = time.perf_counter()
    df = spark.range(1).select(compile_formula("/".join(["v"] * 31), {"v": F.lit(2.0)}).alias("x"))
    assert df.first().x == 2.0**-29 and time.perf_counter() - start < 5
    with pytest.raises(ValueError):
        compile_formula("(" * 200 + "1" + ")" * 200, {})
