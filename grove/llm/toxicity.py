"""Toxicity: character n-gram linear classifier with naive Bayes scaling.

Features are the presence of character 3- to 6-grams of the lower-cased whole
text.  Each is scaled by its log-count ratio r = log((p + 1) / (n + 1)) + const,
p and n being the numbers of toxic and other training documents with it, and
a logistic regression is fitted on the scaled features.

The learner reads at most ``max_per_class`` labelled documents of each
class (chosen by a hash of doc_id), counts n-grams on the executors, keeps the
``n_features`` with the largest naive Bayes weight, and fits the regression on
the driver over their sparse rows: all three sizes are parameters and do
not grow with the input.  Scoring covers every whole text.

Defined results: null and empty texts have no features, so their score is
that of the bias; null labels are ignored and the largest label of a document
counts; labels without a document are ignored; of several rows of one labelled
doc_id the least text teaches; without labels of both classes the score is the
share of toxic labels (0 without any); repeated rows get equal scores; other columns stay; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm.common import lean, lower_az, mix64, sliced, stored

ORDERS = (3, 4, 5, 6)
_P = np.uint64(0x9E3779B97F4A7C15)
SLOT_BITS = 20


def ngram_hashes(text: str | None) -> np.ndarray:
    """Hashes of all n-grams of the text (one entry per place)."""
    if not text:
        return np.zeros(0, np.uint64)
    padded = f" {lower_az(text)} "
    c = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    out, h = [], c
    for n in range(2, max(ORDERS) + 1):
        if len(c) < n:
            break
        h = h[:-1] * _P + c[n - 1:]
        if n in ORDERS:
            out.append(h * _P + np.uint64(n))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


@dataclass
class ToxicityModel:
    """Weights of the kept n-gram hashes (sorted by slot) and the bias."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.hashes, self.weights = self.hashes.astype(np.uint64), self.weights.astype(np.float64)
        slot = self.slots(self.hashes)
        order = np.lexsort((self.hashes, slot))
        self.hashes, self.weights, slot = self.hashes[order], self.weights[order], slot[order]
        self.first = np.full(1 << SLOT_BITS, -1, dtype=np.int32)
        self.first[slot[::-1]] = np.arange(len(slot) - 1, -1, -1)
        self.depth = int(np.bincount(slot).max()) if len(slot) else 0

    @staticmethod
    def slots(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * _P >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def features(self, text: str | None) -> np.ndarray:
        """Sorted indices of the kept n-grams in a text."""
        found = []
        h = ngram_hashes(text)
        for i in range(0, len(h), 1 << 18):  # long texts in steps, to bound memory
            part = h[i:i + (1 << 18)]
            at = self.first[self.slots(part)]
            some = np.flatnonzero(at >= 0)
            at, part = at[some].astype(np.int64), part[some]
            for k in range(self.depth):
                j = np.minimum(at + k, len(self.hashes) - 1)
                found.append(np.unique(j[self.hashes[j] == part]))
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weights[self.features(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit_logistic(indptr: np.ndarray, index: np.ndarray, r: np.ndarray, y: np.ndarray,
                 l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights on features scaled by r (gradient descent with momentum and
    step sizes per feature); classes weigh the same in total."""
    rows = np.repeat(np.arange(len(y)), np.diff(indptr))
    cls = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, b = np.zeros(len(r)), 0.0
    m, v, t = np.zeros(len(r) + 1), np.zeros(len(r) + 1), 0
    for t in range(1, steps + 1):
        z = b + np.bincount(rows, weights=(w * r)[index], minlength=len(y))
        g = cls * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        grad = np.append(r * np.bincount(index, weights=g[rows], minlength=len(r)) + l2 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        step = 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w * r, float(b)


def training_rows(docs: DataFrame, labels: DataFrame, max_per_class: int) -> DataFrame:
    """(doc_id, text, y) of the chosen sample, smallest hashes first."""
    lab = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("y"))
    h = F.xxhash64("doc_id")
    picked = [lab.where(c).orderBy(h, "doc_id").limit(max_per_class)
              for c in (F.col("y") == 1, F.col("y") != 1)]
    both = picked[0].unionByName(picked[1])  # at most 2 * max_per_class rows of two numbers
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull())
    found = texts.join(F.broadcast(both), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    return found.select("doc_id", "text", (F.col("y") == 1).cast("int").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = 3000, n_features: int = 30_000,
        min_docs: int = 4, l2: float = 5e-3, steps: int = 150) -> ToxicityModel:
    """Learns from the rows of ``labels`` (doc_id, toxic); leave held-out ones
    out before calling."""
    sample = stored(training_rows(docs, labels, max_per_class), "toxic-sample")
    n = dict(sample.groupBy("y").count().collect())
    if not n.get(0) or not n.get(1):
        bias = {(True, False): 50.0, (False, True): -50.0, (False, False): -50.0}[bool(n.get(1)), bool(n.get(0))]
        return ToxicityModel(np.zeros(0), np.zeros(0), bias)

    @lean("toxicity")
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents of each class with an n-gram, combined per task."""
        for b in batches:
            ys = np.array(b.column(1).to_pylist())
            per = [np.unique(ngram_hashes(t)) for t in b.column(0).to_pylist()]
            for y in (0, 1):
                mine = [p for p, v in zip(per, ys) if v == y]
                u, c = np.unique(np.concatenate(mine), return_counts=True) if mine else (np.zeros(0, np.uint64),) * 2
                keep = c > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u[keep].view(np.int64)), pa.array(c[keep].astype(np.int64) * (y == 1)),
                     pa.array(c[keep].astype(np.int64) * (y == 0))], names=["h", "p", "q"])

    # texts go through in small batches: an n-gram array has eight bytes for each place and order
    counts = sample.select("text", "y").mapInArrow(_small(grams), "h long, p long, q long").groupBy("h").agg(
        F.sum("p").alias("p"), F.sum("q").alias("q")).where(F.col("p") + F.col("q") >= min_docs)
    p1, q1 = (F.col("p") + 1) / F.lit(n[1] + 2.0), (F.col("q") + 1) / F.lit(n[0] + 2.0)
    r = F.log(p1 / q1)
    share = (F.col("p") / n[1] + F.col("q") / n[0]) / 2
    weight = F.abs(r) * F.sqrt(share * (1 - share / 2))
    top = counts.withColumn("r", r).orderBy(weight.desc(), "h").limit(n_features).select("h", "r").toPandas()
    model = ToxicityModel(top["h"].to_numpy().view(np.uint64), top["r"].to_numpy(), 0.0)
    ratios = model.weights.copy()
    shared = sample.sparkSession.sparkContext.broadcast(model)

    @lean("toxicity")
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays(
                [b.column(1), b.column(2),
                 pa.array([shared.value.features(t).astype("<i4").tobytes() for t in b.column(0).to_pylist()], pa.binary())],
                names=["doc_id", "y", "x"])

    data = sample.select("text", "doc_id", "y").mapInArrow(rows, "doc_id long, y int, x binary").toPandas()
    data = data.sort_values(["doc_id", "y"])
    x = [np.frombuffer(b, dtype="<i4") for b in data["x"]]
    index = np.concatenate(x) if x else np.zeros(0, np.int32)
    indptr = np.cumsum([0, *(len(i) for i in x)])
    w, b = fit_logistic(indptr, index, ratios, data["y"].to_numpy(), l2, steps)
    return ToxicityModel(model.hashes, w, b)


def _small(fn, rows: int = 200):
    """Runs ``fn`` over slices of the batches, ``rows`` rows each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))
    return run


def score_documents(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on);
    columns of those names are replaced."""
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = docs.select(*(F.col(f"`{c}`") for c in names))
    at = names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in sliced(batches):
            s = np.array([m.score(t) for t in b.column(at).to_pylist()], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             names=[*names, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, score double, predicted int")
