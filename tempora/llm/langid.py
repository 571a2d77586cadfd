"""Language identification by string kernels.

Two texts are as alike as the n-grams that both have: for each length n, the
number of common n-grams over the geometric mean of their numbers (a presence
kernel), blended over n = 1, 2, 3 bytes of the lower-cased text. Bounded samples
of each language give landmarks (Nyström) and rows for kernel ridge regression,
one language versus the rest. A batch of texts is scored by two matrix
products: presence vectors by landmarks, and kernel values by coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, table
from .samples import bounded_sample

#: Texts of each language that the model is fitted on (about), and landmarks in all, at most.
SAMPLE_PER_LANGUAGE, LANDMARKS = 500, 256
#: Bins of the n-grams of 1, 2 and 3 bytes.
BINS = (256, 4096, 8192)
WIDTH = sum(BINS)
#: The language of texts without letters.
UNKNOWN = "und"
#: Rows that are expanded to presence vectors at once.
ROWS = 256


def present(text: str | None) -> np.ndarray | None:
    """Which bins the n-grams of a text fall into; None for a text without letters."""
    if not text or not any(map(str.isalpha, text)):
        return None
    b = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32)
    out = np.zeros(WIDTH, bool)
    out[b] = True
    at = BINS[0]
    for n, bins in enumerate(BINS[1:], 2):
        if len(b) >= n:
            h = np.zeros(len(b) - n + 1, np.uint32)
            for i in range(n):
                h = (h + b[i : i + len(h)]) * np.uint32(2654435761)
                h ^= h >> np.uint32(15)
            out[at + (h % np.uint32(bins)).astype(np.int64)] = True
        at += bins
    return out


def normalised(x: np.ndarray) -> np.ndarray:
    """Rows of presence flags so scaled that a product of two rows is the blended kernel."""
    out, at = x.astype(np.float32), 0
    for bins in BINS:
        part = out[:, at : at + bins]
        part /= np.sqrt(np.maximum(part.sum(1, keepdims=True), 1) * len(BINS))
        at += bins
    return out


@dataclass
class Model:
    """languages, landmarks (WIDTH x m) and coefficients (m x languages)."""

    languages: list[str]
    landmarks: np.ndarray
    coefficients: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return normalised(x) @ self.landmarks @ self.coefficients


def fit_rows(flags: np.ndarray, lang: list[str], ridge: float = 1e-4) -> Model:
    """Nyström kernel ridge regression on rows of presence flags."""
    languages = sorted(set(lang))
    y = np.array([languages.index(v) for v in lang], np.int64)
    if not languages:
        return Model([], np.zeros((WIDTH, 0), np.float32), np.zeros((0, 0), np.float32))
    # the same number of landmarks of each language, in the given order
    each = max(1, LANDMARKS // len(languages))
    chosen = np.sort(np.concatenate([np.flatnonzero(y == k)[:each] for k in range(len(languages))]))
    landmarks = normalised(flags[chosen]).T.copy()
    k_mm = (landmarks.T @ landmarks).astype(np.float64)
    share = np.bincount(y, minlength=len(languages)) * len(languages) / len(y)
    a, b = np.zeros_like(k_mm), np.zeros((len(chosen), len(languages)))
    for i in range(0, len(y), ROWS):
        k = (normalised(flags[i : i + ROWS]) @ landmarks).astype(np.float64)
        w = k / share[y[i : i + ROWS]][:, None]  # languages count alike
        a += w.T @ k
        b += w.T @ np.where(y[i : i + ROWS, None] == np.arange(len(languages))[None, :], 1.0, -1.0)
    a += ridge * len(y) * k_mm + 1e-8 * np.trace(a) / len(a) * np.eye(len(a))
    return Model(languages, landmarks, np.linalg.solve(a, b).astype(np.float32))


def fit(docs: DataFrame, cap: int = SAMPLE_PER_LANGUAGE) -> Model:
    """The model from the text and lang of documents that are not held out."""
    known = docs.select("doc_id", F.col("text").alias("_text"), F.col("lang").alias("_lang")).filter(~held_out() & F.col("_lang").isNotNull() & F.col("_text").isNotNull())
    sample, _ = bounded_sample(known, "_lang", cap)

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(v, p) for v, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (p := present(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in got], pa.string()), pa.array([np.packbits(p).tobytes() for _, p in got], pa.binary())], ["lang", "flags"])

    rows = sample.select("_lang", "_text").mapInArrow(flags, "lang string, flags binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (hash_of(r["flags"]), r["lang"]))  # an order that has nothing to do with where rows stood
    bits = np.array([np.unpackbits(np.frombuffer(r["flags"], np.uint8), count=WIDTH).astype(bool) for r in rows]).reshape(len(rows), WIDTH)
    return fit_rows(bits, [r["lang"] for r in rows])


def hash_of(raw: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(raw)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1, the softmax of the languages' margins).

    Null text and text without letters get ``und`` and 0, and so do all texts if
    the model has learned no language. Input columns with the names of results are
    replaced. Repeated rows get equal results; an empty table gives no rows.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            at, flags = [], []

            def settle():
                s = model.scores(np.array(flags)) * 4
                p = np.exp(s - s.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                for i, best, row in zip(at, p.argmax(1), p, strict=True):
                    pred[i], score[i] = model.languages[best], row[best]
                at.clear()
                flags.clear()

            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                if model.languages and (f := present(text.as_py())) is not None:
                    at.append(i)
                    flags.append(f)
                if len(at) == ROWS:
                    settle()
            if at:
                settle()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    out = T.StructType([rows.schema[c] for c in keep]).add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, out)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
