"""Benchmark decontamination with spaced seeds.

Fixed masks select token positions and ignore the others, so a seed survives
substitutions at ignored places.  With the default masks, tokens and penalty no
overlap of any length is without a seed (the tests search all patterns of equal
and different tokens), so the result is that of comparing all diagonals.  Every window of every training text and of
every benchmark item is hashed under each mask, equal hashes are joined, and
around each hit the two token sequences are compared on their common diagonal:
the best-scoring run (+1 for equal tokens, -``penalty`` for different ones)
is an overlap if it has at least ``min_tokens`` equal tokens and starts and
ends with an equal one.  Items shorter than ``min_tokens`` must be found whole.

The benchmark is the stated query set.  It is joined in blocks of at most
``block_tokens`` tokens (counted, then broadcast), one pass over the texts
for each block, so memory is bounded for any benchmark and nothing is left
out.  Texts are read whole and never shuffled; only overlaps are.

Defined results: null or empty texts and items overlap with nothing; repeated
items or documents are reported each under their id (one row per pair of ids);
a null id is reported as null; an empty table gives no overlaps; other columns
are ignored by ``overlaps`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm.common import WordHashes, mix64, only

#: Selected positions are 1; each mask starts and ends with one.  Chosen by enumeration.
MASKS = ("10010010111", "10001000010111", "100010101011", "11100111", "111111")
MIN_TOKENS = 13
BLOCK_TOKENS = 2_000_000
_SLOTS = 22
_P = np.uint64(0x9E3779B97F4A7C15)

_WORD = re.compile(r"\w+")
_WORDS = WordHashes("decontam")


def seed_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of each window of token hashes under a mask."""
    m = len(h) - len(mask) + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, len(mask), dtype=np.uint64)
    for i, on in enumerate(mask):
        if on == "1":
            out *= _P
            out += h[i:i + m]
            out ^= out >> np.uint64(29)
    return mix64(out)


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words: runs of letters, digits and underscores, lower case."""
    return _WORDS([w.encode("utf-8") for w in _WORD.findall(text.lower())] if text else [])


class BenchmarkBlock:
    """Seeds of a block of items, sorted, with a bitmap in front."""

    def __init__(self, items: list[tuple[int | None, str | None]], masks: tuple[str, ...], min_tokens: int):
        self.masks, self.min_tokens = masks, min_tokens
        self.ids, self.toks = [], []
        seeds, item, place = [], [], []
        for item_id, text in items:
            t = tokens(text)
            if not len(t):
                continue
            k = len(self.ids)
            self.ids.append(item_id)
            self.toks.append(t)
            for mask in masks:
                # an item shorter than a mask is its own seed, as one whole
                s = seed_hashes(t, mask if len(t) >= len(mask) else "1" * len(t))
                seeds.append(s)
                item.append(np.full(len(s), k, np.int32))
                place.append(np.arange(len(s), dtype=np.int32))
        s = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(s, kind="stable")
        self.seeds = s[order]
        self.item = np.concatenate(item)[order] if seeds else np.zeros(0, np.int32)
        self.place = np.concatenate(place)[order] if seeds else np.zeros(0, np.int32)
        self.bitmap = np.zeros(1 << _SLOTS, dtype=bool)
        self.bitmap[(self.seeds >> np.uint64(64 - _SLOTS)).astype(np.int64)] = True
        self.short = sorted({len(t) for t in self.toks if any(len(t) < len(m) for m in masks)})

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Distinct (item, diagonal) pairs of a text: diagonal is the text's
        position minus the item's."""
        out = []
        for mask in {*self.masks, *("1" * n for n in self.short)}:
            s = seed_hashes(h, mask)
            at = np.flatnonzero(self.bitmap[(s >> np.uint64(64 - _SLOTS)).astype(np.int64)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(self.seeds, s[at]), np.searchsorted(self.seeds, s[at], side="right")
            n = hi - lo
            if not n.any():
                continue
            which = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            pairs = np.stack([self.item[which].astype(np.int64), np.repeat(at, n) - self.place[which]], axis=1)
            out.append(np.unique(pairs, axis=0))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)

    def overlaps(self, text: str | None, penalty: float) -> list[tuple]:
        """Best overlap with each item: (item_id, start, length, matched)."""
        h = tokens(text)
        best: dict[int, tuple] = {}
        for k, d in self.hits(h).tolist():
            t = self.toks[k]
            a, b = max(0, d), min(len(h), d + len(t))
            equal = h[a:b] == t[a - d:b - d]
            total = np.r_[0.0, np.cumsum(np.where(equal, 1.0, -penalty))]
            low = np.minimum.accumulate(total)
            end = int(np.argmax(total - low))
            start = int(np.argmax(total[:end + 1] == low[end]))
            start += int(np.argmax(equal[start:end]))  # ties at the left end
            matched = int(equal[start:end].sum())
            if matched >= min(self.min_tokens, len(t)):
                mine = (matched, -(end - start), -(a + start))
                best[k] = max(best.get(k, mine), mine)
        return [(self.ids[k], -s, -n, m) for k, (m, n, s) in sorted(best.items())]


def blocks_of(benchmark: DataFrame, block_tokens: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in blocks of about ``block_tokens`` tokens; one is on the driver at a time."""
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = b.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    parts = max(1, -(-size // block_tokens))
    for k in range(parts):
        part = b if parts == 1 else b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        yield sorted(((r.item_id, r.text) for r in part.toLocalIterator()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_tokens: int = MIN_TOKENS,
             penalty: float = 2.0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each overlapping (doc_id, item_id): start (word of the
    text), length (words) and matched (equal words) of the best overlap."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sc = docs.sparkSession.sparkContext
    fields = "doc_id long, item_id long, start long, length long, matched long"

    def one(items: list) -> DataFrame:
        shared = sc.broadcast(BenchmarkBlock(items, masks, min_tokens))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            only("decontam")
            block = shared.value
            for b in batches:
                rows = [(d, *o) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                        for o in block.overlaps(t, penalty)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)],
                                                 names=["doc_id", "item_id", "start", "length", "matched"])

        return docs.mapInArrow(run, fields)

    out = None
    for items in blocks_of(benchmark, block_tokens):
        out = one(items) if out is None else out.unionByName(one(items))
    best = F.max_by(F.struct("start", "length", "matched"), F.struct("matched", -F.col("length"), -F.col("start")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_tokens: int = MIN_TOKENS,
                  penalty: float = 2.0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``docs`` without the rows that overlap with a benchmark item: each block
    filters in place, without a shuffle."""
    at = docs.columns.index("text")
    sc = docs.sparkSession.sparkContext
    for items in blocks_of(benchmark, block_tokens):
        shared = sc.broadcast(BenchmarkBlock(items, masks, min_tokens))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            only("decontam")
            for b in batches:
                yield b.filter(pa.array([not shared.value.overlaps(t, penalty) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
