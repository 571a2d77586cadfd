"""What the text operators share: table reading, cut lineage, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``, as a Java regular expression; bytes.split() has the same set.
SPACES = "[ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a session of one machine takes a folder of its own; on a cluster, where each machine would write its own, it is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="tempora-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


#: Lets Spark delete a query's shuffle files as soon as its result is written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table to the shared folder and read again.

    Lineage is cut, lost executors cost nothing of it, and its shuffle files go at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tempora/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    if _SCRATCH:
        _SCRATCH[-1].append(out)
    return out


_SCRATCH: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what ``saved`` has written within it, but for results that its function ``keep`` has saved."""
    _SCRATCH.append([])
    kept = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(saved(df))
        return kept[-1]

    try:
        yield keep
    finally:
        mine = _SCRATCH.pop()
        discard(*[t for t in mine if all(t is not k for k in kept)])
        if _SCRATCH:
            _SCRATCH[-1].extend(kept)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``saved`` has made and that nothing reads any more."""
    for t in tables:
        jvm, sc = t.sparkSession._jvm, t.sparkSession.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(t.saved_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row, whatever later expressions refer to it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def words_of(raw: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text with A-Z lower-cased; splitting bytes keeps other white space in words."""
    return raw.lower().split()


class WordHashes(dict):
    """64-bit hashes of words, remembered for the words seen of late."""

    LIMIT = 500_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit sums over all bits (multiply and shift)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hash of every ``k`` consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mixed(out + h[i : i + n])
    return out


def held_out() -> F.Column:
    """The fifth of documents that no model learns from."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0
