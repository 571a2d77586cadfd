"""Quality by ordinal cumulative-link regression on graded ratings.

A document is a vector of hashed features of its words: the word, its shape
(runs of capitals, small letters, digits and each punctuation mark), and
whether it repeats the word before. One weight vector is shared by all grades;
ordered thresholds cut its score into grades:
P(grade <= k) = sigmoid(threshold_k - w . x). The expected grade ranks
documents and the tail probability P(grade >= wanted) selects them.

The model is fitted on the driver from a bounded sample of rated documents,
which reaches it as sparse hashed counts; scoring reads every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, table
from .samples import bounded_sample

#: Rated documents of each grade that the model is fitted on at most (about), and bins of hashed features.
SAMPLE_PER_GRADE = 3000
BINS = 4096

_CLASSES = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
_RUNS = re.compile(rb"(.)\1+")


class WordBins(dict):
    """word -> bin of the word and bin of its shape, packed; remembered for words seen of late."""

    LIMIT = 500_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        shape = _RUNS.sub(rb"\1", word.translate(_CLASSES))
        a = xxhash.xxh3_64_intdigest(b"w" + word.lower()) % BINS
        b = xxhash.xxh3_64_intdigest(b"s" + shape) % BINS
        x = self[word] = a | b << 16
        return x


def features(raw: bytes | None, bins: WordBins) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature bins of a text and the square roots of their shares of all features."""
    words = (raw or b"").split()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    x = np.fromiter(map(bins.__getitem__, words), np.int64, len(words))
    same = np.count_nonzero(x[1:] == x[:-1])
    count = np.bincount(x & 0xFFFF, minlength=BINS) + np.bincount(x >> 16, minlength=BINS)
    count[0] += same  # the first bin also counts repetitions of the word before
    at = np.flatnonzero(count)
    return at, np.sqrt(count[at] / (2 * len(words))).astype(np.float32)


@dataclass
class OrdinalModel:
    """grades in order, shared weights, and len(grades) - 1 increasing thresholds."""

    grades: list[float]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= grades[k + 1]) for each k, by row."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))

    def expected(self, score: np.ndarray) -> np.ndarray:
        return self.grades[0] + self.tails(score) @ np.diff(self.grades)


def fit_ordinal(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, steps: int = 300) -> OrdinalModel:
    """Weighted maximum likelihood with a ridge on the shared weights, by Adam over all rows."""
    grades = np.unique(y)
    k = len(grades) - 1
    if k < 1:
        return OrdinalModel(list(map(float, grades if len(grades) else [0.0])), np.zeros(x.shape[1], np.float32), np.empty(0))
    above = (y[:, None] >= grades[None, 1:]).astype(np.float32)
    share = np.clip((above * weight[:, None]).sum(0) / weight.sum(), 1e-6, 1 - 1e-6)
    first = np.log((1 - share) / share)
    # thresholds: the first one and the logarithms of the steps between them
    p = np.concatenate([np.zeros(x.shape[1]), first[:1], np.log(np.maximum(np.diff(first), 1e-3))]).astype(np.float64)
    m, v = np.zeros_like(p), np.zeros_like(p)
    d, total = x.shape[1], float(weight.sum())
    for step in range(1, steps + 1):
        gaps = np.exp(p[d + 1 :])
        th = p[d] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = x @ p[:d].astype(np.float32)
        cum = 1 / (1 + np.exp(np.clip(s[:, None] - th[None, :], -30, 30)))  # P(y <= k)
        low = np.concatenate([np.zeros((len(s), 1)), cum, np.ones((len(s), 1))], 1)
        at = np.searchsorted(grades, y)
        rows = np.arange(len(s))
        prob = np.maximum(low[rows, at + 1] - low[rows, at], 1e-9)
        slope = low * (1 - low)
        up, dn = slope[rows, at + 1], slope[rows, at]
        ds = (up - dn) / prob * weight / total  # d(-log prob)/ds
        dth = np.zeros((len(s), k + 2))
        dth[rows, at + 1] -= up / prob * weight / total
        dth[rows, at] += dn / prob * weight / total
        g_th = dth[:, 1:-1].sum(0)
        g = np.concatenate([x.T @ ds.astype(np.float32) + ridge * p[:d], [g_th.sum()], np.cumsum(g_th[::-1])[::-1][1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) * (1 - step / (steps + 1))
    th = p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))])
    return OrdinalModel(list(map(float, grades)), p[:d].astype(np.float32), th)


def fit(docs: DataFrame, labels: DataFrame, grade: str = "quality", cap: int = SAMPLE_PER_GRADE) -> OrdinalModel:
    """The model from documents with a non-null ``grade`` in ``labels`` that aren't held out."""
    rated = labels.select("doc_id", F.col(grade).cast("double").alias("_grade")).filter(~held_out())
    some, weight = bounded_sample(rated, "_grade", cap)
    sample = docs.select("doc_id", F.col("text").alias("_text")).join(F.broadcast(some.dropDuplicates()), "doc_id").select("_grade", "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = WordBins()
        for batch in batches:
            got = [features(t, bins) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            cols = [batch.column(0), pa.array([a.astype("<u2").tobytes() for a, _ in got], pa.binary()), pa.array([v.tobytes() for _, v in got], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["grade", "at", "value"])

    rows = sample.mapInArrow(count, "grade double, at binary, value binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["grade"], r["at"], r["value"]))
    x, y = np.zeros((len(rows), BINS), np.float32), np.array([r["grade"] for r in rows])
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["value"], np.float32)
    return fit_ordinal(x, y, np.array([weight[g] for g in y]))


def score(docs: DataFrame, model: OrdinalModel, wanted: float) -> DataFrame:
    """``docs`` with ``expected_grade`` and ``tail``, the probability of a grade of ``wanted`` or more.

    Null or empty text has no features and gets the probabilities of score 0.
    Input columns with the names of results are replaced. Repeated rows get equal
    results; an empty table gives no rows.
    """
    keep = [c for c in docs.columns if c not in ("expected_grade", "tail")]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("binary").alias("_raw"))
    k = next((i for i, g in enumerate(model.grades[1:]) if g >= wanted), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = WordBins()
        for batch in batches:
            s = np.empty(batch.num_rows)
            for i, raw in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                at, value = features(raw, bins)
                s[i] = model.weights[at] @ value
            tails = model.tails(s)
            tail = np.full(len(s), float(model.grades[-1] >= wanted)) if k is None else tails[:, k]
            if model.grades[0] >= wanted:
                tail = np.ones(len(s))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.expected(s)), pa.array(tail)], [*keep, "expected_grade", "tail"])

    out = T.StructType([rows.schema[c] for c in keep]).add("expected_grade", "double").add("tail", "double")
    return rows.mapInArrow(run, out)


def accepted(docs: DataFrame, labels: DataFrame, wanted: float = 1.0, least: float = 0.5) -> DataFrame:
    """The documents whose probability of grade ``wanted`` or more is at least ``least``."""
    out = score(docs, fit(docs, labels), wanted).filter(F.col("tail") >= least)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model, 1.0)
    return out.select("doc_id", held_out().alias("held_out"), "expected_grade", "tail", (F.col("tail") >= 0.5).alias("accepted"))
