"""Lengths of time as text, read as columns of Spark.

A text is a sum of pieces: numbers followed by a unit, and clock times of two or three
fields. A number alone counts milliseconds. A sign in front holds for all of it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds of a unit by its names (fixed values).
UNITS = {
    1e-9: "ps picosecond picoseconds",
    1e-6: "ns nanosecond nanoseconds",
    1e-3: "us microsecond microseconds",
    1.0: "ms millisecond milliseconds",
    1e3: "s sec secs second seconds",
    6e4: "m min mins minute minutes",
    3.6e6: "h hr hrs hour hours",
    8.64e7: "d day days",
    6.048e8: "w week weeks",
    365.25 * 8.64e7: "y yr yrs year years",
}
MS = {name: ms for ms, names in UNITS.items() for name in names.split()}
#: Milliseconds of the fields of a clock time.
FIELDS = (3.6e6, 6e4, 1e3)


def clock_ms(word: Column) -> Column:
    """``hh:mm``, ``hh:mm:ss`` or ``hh:mm:ss.fff`` as milliseconds; null if it is none. Minutes and seconds are below 60."""
    field = F.transform(F.split(word, ":", -1), lambda x: x.try_cast("double"))
    parts = [F.get(field, F.lit(i)) for i in range(3)]
    whole = (F.size(field) == 2) | (F.size(field) == 3)
    small = (parts[1] < 60) & (F.coalesce(parts[2], F.lit(0.0)) < 60)
    good = whole & F.forall(field, lambda x: x.isNotNull() & (x >= 0)) & small
    return F.when(good, sum((p * ms for p, ms in zip((*parts[:2], F.coalesce(parts[2], F.lit(0.0))), FIELDS, strict=True)), F.lit(0.0)))


def duration_ms(text: Column | str) -> Column:
    """Milliseconds of ``2.5 h``, ``1 d 02:30:00``, ``1h 30min``, ``90``; 0 for null and for what is no length of time."""
    text = F.lower(F.trim(F.col(text) if isinstance(text, str) else text))
    minus = text.startswith("-")
    bare = F.regexp_replace(text, r"^[+-]\s*", "")
    # a blank between a number and the unit that is written right after it, but not within an exponent
    words = F.filter(F.split(F.regexp_replace(bare, r"(?<=[0-9.])(?=[a-z])(?!e[+-]?[0-9])", " "), r"\s+"), lambda w: w != "")
    units = F.create_map(*[F.lit(x) for name, ms in MS.items() for x in (name, float(ms))])
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("open"), F.lit(True).alias("good"))

    def step(so_far: Column, word: Column) -> Column:
        """``open`` is a number that waits for its unit."""
        number = F.when(word.rlike(r"^[0-9.]+(e[+-]?[0-9]+)?$"), word.try_cast("double"))
        piece = F.when(so_far["open"].isNull(), clock_ms(word)).otherwise(so_far["open"] * units[word])
        fits = (number.isNotNull() & so_far["open"].isNull()) | piece.isNotNull()
        return F.struct((so_far["sum"] + F.coalesce(piece, F.lit(0.0))).alias("sum"), number.alias("open"), (so_far["good"] & fits).alias("good"))

    def end(last: Column) -> Column:
        alone = last["open"].isNull() | (F.size(words) == 1)
        return F.when(last["good"] & alone, last["sum"] + F.coalesce(last["open"], F.lit(0.0))).otherwise(0.0)

    ms = F.aggregate(words, start, step, end)
    return F.coalesce(F.when(minus, -ms).otherwise(ms), F.lit(0.0))
