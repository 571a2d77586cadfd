"""Projects: order of definitions, rings, partial replay, and a round trip as text."""

import pytest
from pyspark.sql import functions as F

from tempora.operators import project
from tempora.operators import series as ser
from tempora.operators.project import Definition, File, FileTransform, Project


@pytest.fixture(scope="module")
def frames(spark):
    def frame(names, n):
        return spark.range(n).select(F.col("id").alias("_i"), (F.col("id") * 1000).cast("double").alias("t"), *[(F.col("id") * (k + 1) % 7).cast("double").alias(c) for k, c in enumerate(names)])

    return {"left": frame(["a", "b c"], 30), "right": frame(["x"], 20)}


def sample():
    left = File(
        ("a", "b c"),
        FileTransform(gain=2.0, offset=1.0, start=2000.0, shift=500.0, inverted=("b c",)),
        (Definition("twice", params={"text": "smooth * 2 + `b c`"}), Definition("smooth", "moving_average", "a", {"window": 3}), Definition("rate", "derivative", "twice"), Definition("alone", params={"text": "abs(a) ^ 2"})),
    )
    return Project({"left": left, "right": File(("x",), definitions=(Definition("sum", "integral", "x"),))})


def test_definitions_stand_after_what_they_read():
    left = sample().files["left"]
    assert [d.name for d in left.ordered()] == ["smooth", "twice", "rate", "alone"]
    assert [d.name for d in left.ordered(["twice", "a"])] == ["smooth", "twice"]
    assert Definition("x", params={"text": "log(log) + `b c` - 1e3 * log"}).reads() == ["log", "b c"]


def test_rings_and_gaps_are_errors(frames):
    ring = File(("a",), definitions=(Definition("p", params={"text": "q + a"}), Definition("q", "derivative", "r"), Definition("r", params={"text": "p"})))
    with pytest.raises(ValueError, match="p -> q -> r -> p"):
        ring.ordered()
    with pytest.raises(ValueError, match="no column z, which p reads"):
        File(("a",), definitions=(Definition("p", params={"text": "z"}),)).ordered()
    for bad in ((Definition("a", params={"text": "1"}),), (Definition("p", params={"text": "a"}), Definition("p", params={"text": "a"}))):
        with pytest.raises(ValueError):
            File(("a",), definitions=bad).ordered()
    with pytest.raises(ValueError):
        Project({"left": File(("none",))}).replay(frames)
    with pytest.raises(ValueError):
        Project({"other": File(())}).replay(frames)
    deep = File(("a",), definitions=tuple(Definition(f"d{i}", params={"text": f"d{i - 1}" if i else "a"}) for i in reversed(range(3000))))
    assert len(deep.ordered()) == 3000


def test_round_trip_is_the_direct_plan(frames):
    p = Project.from_json(sample().to_json())
    assert p == sample()
    got = p.replay(frames)
    s = frames["left"].filter("t >= 2000").select("_i", (F.col("t") + 500.0).alias("t"), (F.col("a") * 2 + 1).alias("a"), (F.col("`b c`") * -2 + 1).alias("b c"))
    smooth = ser.moving_average(s.withColumnRenamed("a", "v"), 3).select("_i", F.col("ma").alias("smooth"))
    twice = s.join(smooth, "_i").select("_i", "t", "a", "b c", "smooth", (F.col("smooth") * 2 + F.col("`b c`")).alias("v"))
    want = {r._i: (r.t, r.a, r["b c"], r.smooth, r.v, r.d) for r in ser.derivative(twice).collect()}
    rows = got["left"].collect()
    assert {r._i: (r.t, r.a, r["b c"], r.smooth, r.twice, r.rate) for r in rows} == want and len(rows) == 28
    assert all(r.alone == r.a**2 for r in rows)
    assert got["right"].columns == ["_i", "t", "x", "sum"]


def test_partial_replay_builds_what_is_wanted(frames):
    part = sample().replay(frames, {"left": ["twice"]})
    assert list(part) == ["left"] and part["left"].columns == ["_i", "t", "twice"]
    whole = {r._i: r.twice for r in sample().replay(frames)["left"].collect()}
    assert {r._i: r.twice for r in part["left"].collect()} == whole
    # a column that nothing wanted reads is not computed
    broken = {"left": frames["left"].withColumn("a", F.raise_error(F.lit("read")).cast("double")), "right": frames["right"]}
    assert sample().replay(broken, {"left": ["b c"]})["left"].count() == 28


def test_files_are_matched_by_name_and_columns(frames):
    renamed = {"l2": frames["left"], "right": frames["right"].withColumn("more", F.lit(1))}
    assert project.matching(sample(), renamed) == {"left": "l2", "right": "right"}
    assert project.matching(sample(), {"left": frames["right"]}) == {"right": "left"}
