"""Language-model scores by deleted interpolation.

The probability of a word w after v mixes maximum-likelihood estimates,

    p(w | v) = a2[b] c(v, w) / c(v) + a1[b] c(w) / N + a0[b] / (V + 1),

with weights that depend on the frequency bucket b = log2 of c(v).  The learning
documents are split into retained and deleted ones (by a hash of doc_id); the
weights are learned by expectation-maximisation on the counts of the deleted
part under the estimates of the retained part, and scoring uses the counts of
both.

Counting and scoring run over all texts:

1. ``blocks``: each task cuts its documents into blocks of about ``block_chars``
   (deleted documents into their own) and stores a block's distinct words and
   its texts as positions in that list.
2. Every block sends its distinct words, and likewise its distinct word pairs,
   with their counts to the range of 64-bit hashes they fall in; each range
   adds up the blocks' counts and answers each block (one shuffle there, one
   back).  Frequent words and pairs travel once per block, so none is a hot key.
3. The deleted blocks join their answers; their events are summed into a grid of
   (bucket, f2, f1) cells of fixed size, on which the weights are learned.  Then
   all blocks join their answers and score their documents.

A block, a range and the grid are bounded; their number grows with the input.
Words and pairs are told apart by 64-bit hashes.

Defined results: null and empty texts are the end token alone; a null doc_id is
held out; repeated rows are learned from and scored each; without learning
texts N = V = 0 and every token has probability 1 (score 0); other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm.common import WordHashes, mix64, only, stored

BLOCK_CHARS = 5_000_000
RANGE_KEYS = 1_500_000
BUCKETS = 24
GRID = 96  # cells of each logarithm in the grid of events
START, END = np.uint64(0x9B1A6E3D5F7C2841), np.uint64(0x3C6EF372FE94F82B)
_P = np.uint64(0x9E3779B97F4A7C15)

_WORDS = WordHashes("lm", 200_000)


def _z(a: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: all first bytes, all second ones, ..."""
    a = np.ascontiguousarray(a)
    return zstandard.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), 3)


def _u(b: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _z_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys by their differences."""
    return _z(np.diff(keys, prepend=np.uint64(0)))


def _u_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_u(b, "<u8"), dtype=np.uint64)


def token_hashes(text: str | None) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return np.append(_WORDS(words), END)


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


class Block:
    """Texts of a block: documents, lengths, roles (0 held out, 1 retained, 2
    deleted) and the tokens as positions in the sorted distinct hashes."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, roles: np.ndarray, words: np.ndarray, at: np.ndarray):
        self.ids, self.lengths, self.roles, self.words, self.at = ids, lengths, roles, words, at

    @classmethod
    def load(cls, row) -> Block:
        return cls(_u(row["ids"], "<i8"), _u(row["lengths"], "<i8"), _u(row["roles"], "u1"),
                   _u_sorted(row["words"]), _u(row["at"], "<u4"))

    def before(self) -> np.ndarray:
        """Position of each token's context; len(words) for the start."""
        out = np.empty(len(self.at), dtype=np.int64)
        out[1:] = self.at[:-1]
        first = np.cumsum(self.lengths) - self.lengths
        out[first] = len(self.words)
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct pair hashes, and the position of each token's pair."""
        h = np.append(self.words, START)
        return np.unique(mix64(h[self.before()] * _P + self.words[self.at]), return_inverse=True)

    def counts(self, at: np.ndarray, n: int) -> np.ndarray:
        """How often each of n things is learned from, given its token places."""
        return np.bincount(at[np.repeat(self.roles > 0, self.lengths)], minlength=n).astype("<u4")


BLOCK = "block long, deleted boolean, ids binary, nulls binary, lengths binary, roles binary, words binary, at binary"


def blocks(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Stored blocks of ``docs`` (doc_id, text, role)."""
    names = [c.split(" ")[0] for c in BLOCK.split(", ")]
    types = [pa.int64(), pa.bool_(), *[pa.binary()] * 6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        only("lm")
        base, made = TaskContext.get().partitionId() << 32, 0
        open_: dict[bool, list] = {}  # by deleted: rows (id, role, token hashes)
        chars = {True: 0, False: 0}

        def emit(deleted: bool) -> pa.RecordBatch:
            nonlocal made
            ids, roles, toks = zip(*open_.pop(deleted))
            chars[deleted] = 0
            words, at = np.unique(np.concatenate(toks), return_inverse=True)
            row = [base + made, deleted, _z(np.array([i or 0 for i in ids], "<i8")), _z(np.array([i is None for i in ids], "u1")),
                   _z(np.array([len(t) for t in toks], "<i8")), _z(np.array(roles, "u1")), _z_sorted(words), _z(at.astype("<u4"))]
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        for b in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
            for i, t, r in zip(*(b.column(k).to_pylist() for k in range(3))):
                open_.setdefault(r == 2, []).append((i, r, token_hashes(t)))
                chars[r == 2] += len(t or "") + 64
                if chars[r == 2] >= block_chars:
                    yield emit(r == 2)
        for deleted in list(open_):
            yield emit(deleted)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("role").cast("int"))
    return stored(rows.mapInArrow(run, BLOCK), "lm-blocks")


def exchange(blocks: DataFrame, kind: str, ranges: int) -> DataFrame:
    """Counts over all blocks of each block's distinct words or pairs, in the order
    of the block's sorted hashes: (block, range, all, kept), kept (the counts
    without the deleted part) for deleted blocks only."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                block = Block.load(row)
                keys, at = (block.words, block.at) if kind == "words" else block.pairs()
                n = block.counts(at, len(keys))
                cut = np.searchsorted(_range_of(keys, ranges), np.arange(ranges + 1))
                part = [k for k in range(ranges) if cut[k + 1] > cut[k]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]] * len(part), pa.int64()), pa.array([row["deleted"]] * len(part), pa.bool_()),
                     pa.array(part, pa.int32()),
                     pa.array([_z_sorted(keys[cut[k]:cut[k + 1]]) for k in part], pa.binary()),
                     pa.array([_z(n[cut[k]:cut[k + 1]]) for k in part], pa.binary())],
                    names=["block", "deleted", "range", "keys", "n"])

    def answer(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        every = [_u_sorted(k) for k in g["keys"]]
        ends = np.cumsum([len(k) for k in every])
        starts = np.r_[0, ends[:-1]]
        distinct, at = np.unique(np.concatenate(every), return_inverse=True)
        del every
        kept, gone = np.zeros(len(distinct), "<i8"), np.zeros(len(distinct), "<i8")
        for s, e, n, deleted in zip(starts, ends, g["n"], g["deleted"]):
            total = gone if deleted else kept
            total[at[s:e]] += _u(n, "<u4")  # a block names each key once
        seen = kept + gone
        # totals of the range (for N and V) travel with its first row
        first = np.arange(len(g)) == 0
        return pd.DataFrame({
            "block": g["block"].to_numpy(), "range": key[0], "all": [_z(seen[at[s:e]]) for s, e in zip(starts, ends)],
            "kept": [_z(kept[at[s:e]]) if d else None for s, e, d in zip(starts, ends, g["deleted"])],
            **{c: np.where(first, int(x), 0) for c, x in (("n", seen.sum()), ("v", (seen > 0).sum()),
                                                          ("n0", kept.sum()), ("v0", (kept > 0).sum()))}})

    asked = blocks.mapInArrow(ask, "block long, deleted boolean, range int, keys binary, n binary")
    return asked.groupBy("range").applyInPandas(
        answer, "block long, range int, all binary, kept binary, n long, v long, n0 long, v0 long")


def counted(docs: DataFrame, block_chars: int = BLOCK_CHARS, range_keys: int = RANGE_KEYS) -> tuple[DataFrame, DataFrame, dict]:
    """Stored blocks, the stored answers to them (block, kind, range, all, kept),
    and the totals: n, v over all learning tokens, n0, v0 over the retained
    ones, d and d0 the numbers of documents."""
    table = blocks(docs, block_chars)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = max(1, -(-chars // (8 * range_keys)))
    words, pairs = (exchange(table, kind, n).withColumn("kind", F.lit(kind))
                    for kind, n in (("words", max(1, ranges // 4)), ("pairs", ranges)))
    answers = stored(words.unionByName(pairs), "lm-answers")
    tot = answers.where("kind = 'words'").agg(*(F.sum(c).alias(c) for c in ("n", "v", "n0", "v0"))).first()
    roles = dict(docs.groupBy("role").count().collect())
    totals = {c: tot[c] or 0 for c in ("n", "v", "n0", "v0")}
    totals |= {"d": roles.get(1, 0) + roles.get(2, 0), "d0": roles.get(1, 0)}
    return table, answers.select("block", "kind", "range", "all", "kept"), totals


def answered(table: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks with their answers."""
    parts = answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("kind", "range", "all", "kept"))).alias("counts"))
    return table.join(parts, "block")


class Counted(Block):
    """A block with its counts by token: of the word, its context and the pair."""

    @classmethod
    def load(cls, row) -> Counted:
        out = super().load(row)
        by = {(k, c): np.concatenate([_u(p[c], "<i8") for p in row["counts"] if p["kind"] == k])
              for k in ("words", "pairs") for c in ("all", "kept")[:1 + row["deleted"]]}
        out.word_counts = {c: x for (k, c), x in by.items() if k == "words"}
        _, at = out.pairs()
        out.pair_counts = {c: x[at] for (k, c), x in by.items() if k == "pairs"}
        out.nulls = _u(row["nulls"], "u1").astype(bool)
        return out

    def estimates(self, which: str, n: int, v: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Bucket of each token's context, f2, f1 and f0."""
        c = self.word_counts[which]
        ctx = np.append(c, d)[self.before()]
        f2 = self.pair_counts[which] / np.maximum(ctx, 1)
        return bucket_of(ctx), f2, c[self.at] / max(n, 1), 1 / (v + 1)


def bucket_of(c: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + log2 of its count, up to BUCKETS - 1."""
    return np.minimum(np.frexp(c.astype(np.float64))[1], BUCKETS - 1)


def _cell(f: np.ndarray) -> np.ndarray:
    """0 for zero, else a logarithmic cell of (1e-12, 1]."""
    with np.errstate(divide="ignore"):
        return np.where(f > 0, 1 + np.clip((1 + np.log10(f) / 12) * (GRID - 2), 0, GRID - 2), 0).astype(np.int64)


def events(table: DataFrame, totals: dict) -> pd.DataFrame:
    """The events of deleted, answered blocks in cells: b, how many, mean f2
    and mean f1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                block = Counted.load(b.slice(k, 1).to_pylist()[0])
                bucket, f2, f1, _ = block.estimates("kept", totals["n0"], totals["v0"], totals["d0"])
                cell, at = np.unique((bucket * GRID + _cell(f2)) * GRID + _cell(f1), return_inverse=True)
                sums = [np.bincount(at, weights=w, minlength=len(cell)).astype(np.float64) for w in (np.ones(len(at)), f2, f1)]
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), *(pa.array(s) for s in sums)], names=["cell", "n", "f2", "f1"])

    sums = table.mapInArrow(run, "cell long, n double, f2 double, f1 double").groupBy("cell").agg(
        *(F.sum(c).alias(c) for c in ("n", "f2", "f1"))).toPandas()  # at most BUCKETS * GRID ** 2 rows
    sums = sums.sort_values("cell")
    return pd.DataFrame({"b": sums["cell"] // GRID ** 2, "n": sums["n"], "f2": sums["f2"] / sums["n"], "f1": sums["f1"] / sums["n"]})


def learn_weights(cells: pd.DataFrame, f0: float, rounds: int = 60) -> np.ndarray:
    """Weights (BUCKETS, 3) of f2, f1, f0 by expectation-maximisation.  Buckets
    without events take those of the nearest lower bucket that has some."""
    out = np.zeros((BUCKETS, 3))
    last = np.array([0.0, 0.9, 0.1])
    for b in range(BUCKETS):
        x = cells[cells["b"] == b]
        if len(x):
            f = np.stack([x["f2"], x["f1"], np.full(len(x), f0)], axis=1)
            n = x["n"].to_numpy()
            w = np.array([0.4, 0.4, 0.2]) if b else np.array([0.0, 0.8, 0.2])
            for _ in range(rounds):
                post = w * f
                post /= post.sum(axis=1, keepdims=True)
                w = (n[:, None] * post).sum(axis=0) + 1e-3 * np.array([b > 0, 1, 1])
                w /= w.sum()
            last = w
        out[b] = last
    return out


def score_blocks(table: DataFrame, weights: np.ndarray, totals: dict) -> DataFrame:
    """Scores of every document of answered blocks."""
    n, v, d = totals["n"], totals["v"], totals["d"]
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                block = Counted.load(b.slice(k, 1).to_pylist()[0])
                c = block.word_counts["all"][block.at]
                bucket, f2, f1, f0 = block.estimates("all", n, v, d)
                w = weights[bucket]
                p = w[:, 0] * f2 + w[:, 1] * f1 + w[:, 2] * f0 if n else np.ones(len(c))
                base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
                first = np.cumsum(block.lengths) - block.lengths
                cols = [pa.array(block.ids, pa.int64(), mask=block.nulls), pa.array(block.roles == 0),
                        pa.array(block.lengths), pa.array(np.add.reduceat((c > 0).astype(np.int64), first)),
                        pa.array(np.full(len(first), n, np.int64)), pa.array(np.add.reduceat(base, first)),
                        pa.array(np.add.reduceat(np.log10(p), first))]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return table.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                 "base_score double, score double")


def score_texts(docs: DataFrame, block_chars: int = BLOCK_CHARS, range_keys: int = RANGE_KEYS) -> DataFrame:
    """Scores all ``docs`` (doc_id, text, learn): learns from the rows where learn
    is true, a tenth of which (by a hash of doc_id) is deleted for the weights."""
    learn = F.coalesce(F.col("learn"), F.lit(False))
    role = F.when(~learn, 0).when(F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0, 2).otherwise(1)
    docs = docs.select("doc_id", "text", role.alias("role"))
    table, answers, totals = counted(docs, block_chars, range_keys)
    gone = answered(table.where("deleted"), answers.where("kept IS NOT NULL"))
    weights = learn_weights(events(gone, totals), 1 / (totals["v0"] + 1))
    return score_blocks(answered(table, answers), weights, totals)
