"""Toxicity by gradient-boosted trees over dense features.

The lexicon is learned: words and word beginnings that rated documents marked
toxic have far more often than the others. A text becomes a few dense features:
densities of lexicon words, also of those found only after undoing
obfuscation, their nearness to the second person, and rates of capitals,
punctuation and obfuscated words. Boosted trees turn them into a margin, and an
isotonic step function turns the margin into a probability.

Lexicon, trees and steps are each fitted on other rows than those that they are
judged by (two folds), from a bounded sample of rated documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, saved, table
from .samples import bounded_sample

#: Rated documents of each class that the model is fitted on at most (about), and entries of the lexicon.
SAMPLE_PER_CLASS, LEXICON = 4000, 400
#: Letters of the word beginnings that may be entries.
BEGINNINGS = (4, 5, 6)
#: Words from a lexicon word within which a second person counts as near.
NEAR = 5

#: The second person in English, French, German and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes ti tus vosotros vuestro".split())

#: Characters that stand for letters in obfuscated words.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "+": "t", "|": "l"})

#: Words of small letters alone have nothing to count but these, and take a shorter way to the same codes.
PLAIN = True
_STRETCHED = re.compile(r"(.)\1\1")

FEATURES = [
    "hits", "hit_density", "hit_weight", "densest", "hidden_hits", "near_you", "you_rate", "capital_rate", "capital_words",
    "exclaim_rate", "question_rate", "other_mark_rate", "digit_in_word_rate", "stretched_rate", "log_words", "distinct_hits",
]


def tokens(word: str) -> list[str]:
    """The word without marks at its ends, and its beginnings (with a dash), as entries of the lexicon."""
    w = word.lower().strip("\"'.,;:!?()[]{}<>*_-|&%$#@~`^+=/\\")
    return [w, *(w[:n] + "-" for n in BEGINNINGS if len(w) >= n)] if w else []


class WordCodes(dict):
    """word -> what the features need of it, packed; remembered for words seen of late."""

    LIMIT = 500_000

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon
        self.entry = {k: i + 1 for i, k in enumerate(lexicon)}
        self.weight = np.array([0.0, *lexicon.values()])
        self.beyond: dict[str, np.ndarray] = {}

    def find(self, word: str) -> int:
        return max((self.entry.get(t, 0) for t in tokens(word)), key=lambda i: self.weight[i], default=0)

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        if PLAIN and word.isascii() and word.islower() and (inside := word.rstrip(".,")).isalpha() and len(inside) <= 63 and not _STRETCHED.search(inside):
            found = [i for t in (inside, *[inside[:n] + "-" for n in BEGINNINGS if len(inside) >= n]) if (i := self.entry.get(t))]
            entry = max(found, key=lambda i: self.weight[i]) if found else 0
            x = self[word] = entry | (inside in SECOND_PERSON) << 20 | len(inside) << 42
            return x
        entry, hidden = self.find(word), 0
        letters = sum(map(str.isalpha, word))
        inside = word.strip("\"'.,;:!?()[]{}")
        digits = letters > 0 and any(not c.isalpha() and c not in "'-’." for c in inside)
        stretched = any(a == b == c and a.isalpha() for a, b, c in zip(word, word[1:], word[2:], strict=False))
        if not entry and (digits or stretched):
            x = word.lower().translate(_LEET)
            plain = "".join(c for i, c in enumerate(x) if c.isalpha() and x[max(0, i - 1) : i] != c) if stretched else "".join(filter(str.isalpha, x))
            hidden = self.find(plain)
        capitals = sum(map(str.isupper, word))
        you = word.lower().strip("\"'.,;:!?()") in SECOND_PERSON
        other = sum(not c.isalnum() and c not in "!?.,'-" for c in word)
        # fields of bits: entry 10, hidden 10, then flags and small counts
        x = entry | hidden << 10 | you << 20 | (letters > 1 and capitals == letters) << 21 | digits << 22 | stretched << 23
        counts = np.array([word.count("!"), word.count("?"), other, capitals, letters])
        packed = np.minimum(counts, [15, 15, 15, 63, 63])
        for count, shift in zip(packed.tolist(), (24, 28, 32, 36, 42), strict=True):
            x |= count << shift
        if (counts > packed).any():  # what the fields have no room for is kept beside them
            x |= 1 << 48
            self.beyond[word] = counts - packed
        self[word] = x
        return x


def features(text: str | None, codes: WordCodes) -> np.ndarray:
    """The dense features of a whole text; all zero if it has no words."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return np.zeros(len(FEATURES))
    x = np.fromiter(map(codes.__getitem__, words), np.int64, n)
    own, hidden = x & 1023, x >> 10 & 1023
    entry = np.where(own > 0, own, hidden)
    at, you = np.flatnonzero(entry), np.flatnonzero(x >> 20 & 1)
    near, densest = 0, 0.0
    if len(at):
        if len(you):
            i = np.searchsorted(you, at)
            gap = np.minimum(np.abs(at - you[np.minimum(i, len(you) - 1)]), np.abs(at - you[np.maximum(i - 1, 0)]))
            near = np.count_nonzero(gap <= NEAR)
        sums = np.concatenate([[0], np.cumsum(entry > 0)])
        densest = (sums[np.minimum(at + 50, n)] - sums[at]).max()
    beyond = sum((codes.beyond[words[i]] for i in np.flatnonzero(x >> 48 & 1)), np.zeros(5, np.int64))
    if len(codes.beyond) > 10_000:
        codes.clear()
        codes.beyond.clear()
    letters = max(1, int((x >> 42 & 63).sum() + beyond[4]))
    rate = lambda shift, bits, more=0: float((x >> shift & bits).sum() + more) / n
    return np.array([
        len(at), len(at) / n, codes.weight[entry[at]].sum() / math.sqrt(n), densest, np.count_nonzero(hidden), near, len(you) / n, float((x >> 36 & 63).sum() + beyond[3]) / letters,
        rate(21, 1), rate(24, 15, beyond[0]), rate(28, 15, beyond[1]), rate(32, 15, beyond[2]), rate(22, 1), rate(23, 1), math.log1p(n), len(np.unique(entry[at])),
    ])


@dataclass
class Boosted:
    """Trees of depth DEPTH over binned features; each is (feature, threshold) by node and the leaves' values."""

    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - len(feature)]
        return out


DEPTH, ROUNDS, RATE, LEAST = 3, 80, 0.2, 1.0


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
    """Second-order boosting of the logistic loss on histograms of at most 64 quantile bins."""
    share = np.clip((y * weight).sum() / max(weight.sum(), 1e-9), 1e-4, 1 - 1e-4)
    model = Boosted(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    margin, inner = np.full(len(y), model.base), 2**DEPTH - 1
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        g, h = (p - y) * weight, np.maximum(p * (1 - p), 1e-6) * weight
        feature, threshold, cut = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, 64)
        node = np.zeros(len(y), np.int64)
        for k in range(inner):
            own = np.flatnonzero(node == k)
            gs, hs = g[own].sum(), h[own].sum()
            best = 1e-6
            for j, e in enumerate(edges):
                if len(own) < 4 or not len(e):
                    continue
                gl = np.cumsum(np.bincount(binned[own, j], g[own], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[own, j], h[own], len(e) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(hl < LEAST) | (hs - hl < LEAST)] = 0
                if (i := int(gain.argmax())) >= 0 and gain[i] > best:
                    best, feature[k], threshold[k], cut[k] = gain[i], j, e[i], i
            node[own] = 2 * k + 1 + (binned[own, feature[k]] > cut[k])
        leaf = np.zeros(inner + 1)
        for k in range(inner + 1):
            own = node == inner + k
            leaf[k] = -RATE * g[own].sum() / (h[own].sum() + 1)
        model.trees.append((feature, threshold, leaf))
        margin += leaf[node - inner]
    return model


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the increasing function nearest to ``y``, by pooling adjacent violators."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # lowest and highest score, weight, mean
    for s, v, w in zip(score[order], y[order], weight[order], strict=True):
        if blocks and blocks[-1][1] == s:
            b = blocks[-1]
            b[3] = (b[3] * b[2] + v * w) / (b[2] + w)
            b[2] += w
        else:
            blocks.append([s, s, w, float(v)])
        while len(blocks) > 1 and blocks[-2][3] >= blocks[-1][3]:
            hi = blocks.pop()
            lo = blocks[-1]
            lo[3] = (lo[3] * lo[2] + hi[3] * hi[2]) / (lo[2] + hi[2])
            lo[1], lo[2] = hi[1], lo[2] + hi[2]
    return np.array([v for b in blocks for v in b[:2]]), np.array([b[3] for b in blocks for _ in range(2)])


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Boosted
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        m = self.trees.margin(x)
        if not len(self.knots[0]):
            return 1 / (1 + np.exp(-m))
        # a little of the margin keeps the order within a step
        return np.clip(0.98 * np.interp(m, *self.knots) + 0.02 / (1 + np.exp(-m)), 0, 1)


def learn_lexicon(sample: DataFrame, size: int = LEXICON) -> list[dict[str, float]]:
    """Lexicons of three kinds: of fold 1, of fold 0 (so that each fold is judged by the other's), and of both.

    An entry stands in at least three toxic documents, and in a share of them at least 6 times that of the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, fold, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), ([], [], [])
            for y, k, text in zip(toxic, fold, batch.column(2).to_pylist(), strict=True):
                for t in {t for w in set((text or "").split()) for t in tokens(w)}:
                    for o, v in zip(out, (t, y, k), strict=True):
                        o.append(v)
            for i in range(0, len(out[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(o[i : i + 100_000], t) for o, t in zip(out, (pa.string(), pa.int32(), pa.int32()), strict=True)], ["entry", "toxic", "fold"])

    n = {(r.toxic, r.fold): r["count"] for r in sample.groupBy("toxic", "fold").count().collect()}
    own = lambda y, k: F.sum(((F.col("toxic") == y) & (F.col("fold") == k)).cast("int")).alias(f"n{y}{k}")
    counts = sample.select("toxic", "fold", "text").mapInArrow(run, "entry string, toxic int, fold int").groupBy("entry").agg(*[own(y, k) for y in (0, 1) for k in (0, 1)])
    out = []
    for folds in ((1,), (0,), (0, 1)):
        hit, miss = (sum((F.col(f"n{y}{k}") for k in folds), F.lit(0)) for y in (1, 0))
        n1, n0 = (sum(n.get((y, k), 0) for k in folds) for y in (1, 0))
        odds = F.log((hit + 0.5) / (n1 + 1)) - F.log((miss + 0.5) / (n0 + 1))
        best = counts.select("entry", odds.alias("odds"), hit.alias("hit")).filter((F.col("hit") >= 3) & (F.col("odds") > math.log(6)))
        best = best.orderBy(F.desc(F.col("odds") * F.sqrt("hit")), "entry").limit(size)
        out.append({r.entry: r.odds for r in best.collect()})
    return out


def fit(docs: DataFrame, labels: DataFrame, cap: int = SAMPLE_PER_CLASS) -> Model:
    """The model from documents with a non-null ``toxic`` in ``labels`` that are not held out."""
    rated = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(~held_out() & F.col("toxic").isin(0, 1))
    some, weights = bounded_sample(rated, "toxic", cap)
    fold = (F.crc32(F.col("doc_id").cast("string")) % 2).cast("int").alias("fold")
    sample = saved(docs.select("doc_id", "text").join(F.broadcast(some.dropDuplicates()), "doc_id").select("doc_id", "toxic", fold, "text"))
    lexicons = learn_lexicon(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = [WordCodes(x) for x in lexicons]
        for batch in batches:
            fold = batch.column(2).to_pylist()
            rows = [np.concatenate([features(t, codes[k]), features(t, codes[2])]) for k, t in zip(fold, batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], ["doc_id", "toxic", "fold", "x"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(run, f"doc_id {kind}, toxic int, fold int, x array<double>").toArrow().to_pylist()
    rows.sort(key=lambda r: (str(r["doc_id"]), r["x"]))
    x = np.array([r["x"] for r in rows]).reshape(len(rows), 2 * len(FEATURES))[:, : len(FEATURES)]
    y, fold = np.array([r["toxic"] for r in rows], float), np.array([r["fold"] for r in rows])
    weight = np.array([weights[int(v)] for v in y])
    oof = np.zeros(len(y))
    for k in (0, 1):
        oof[fold == k] = boost(x[fold != k], y[fold != k], weight[fold != k]).margin(x[fold == k])
    return Model(lexicons[2], boost(x, y, weight), isotonic(oof, y, weight) if len(y) else (np.empty(0), np.empty(0)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5).

    Null, empty and wordless texts have all features zero and are scored too. Input
    columns with the names of results are replaced. Repeated rows get equal
    results; an empty table gives no rows.
    """
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes(model.lexicon)
        for batch in batches:
            x = np.array([features(t.as_py(), codes) for t in batch.column(batch.num_columns - 1)]).reshape(batch.num_rows, len(FEATURES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    out = T.StructType([rows.schema[c] for c in keep]).add("score", "double").add("predicted", T.IntegerType())
    return rows.mapInArrow(run, out)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
