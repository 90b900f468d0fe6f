"""Line deduplication with two Bloom filters.

A line's key is the line stripped of ASCII white space and with A-Z lower-cased.
Keys of at least ``min_chars`` code points found in two or more documents
keep their lines only in the smallest doc_id that holds them.

1. Every task sets the hashes of its documents' keys in a once filter, or in
   the twice filter if they were set before; partial filters are merged segment
   by segment, where the AND of two once filters joins the twice filter.
   No key of two documents can be missing from the twice filter.
2. A second pass probes each key; only suspected repeats are shuffled, with the
   full key.  min and max of doc_id (combined before the shuffle) confirm the
   repeat exactly and choose the first holder.
3. The keys to drop join their documents, whose lines are filtered.

A filter has about ``bits_per_line`` bits a line, at most ``max_bits``
(the twice filter is broadcast: 128 MB).  Beyond that bound more keys are
suspected and shuffled; the result stays the same.

Defined results: null or empty texts are one empty line; rows of one doc_id are
one document; a null doc_id counts as one document behind all others; other
columns stay; an empty table stays empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm.common import WS, lean, lower_az, sliced, stored

MIN_CHARS = 10
SEGMENT = 1 << 19  # bits of a filter that travel as one row
PROBES = 4
FAN_IN = 256  # partial filters merged by one task at most
NO_ID = (1 << 63) - 1


def key_of(line: str) -> str:
    return lower_az(line.strip(WS))


def keys_of(text: str | None, min_chars: int) -> list[str]:
    """The key of each line; too short ones as an empty string."""
    return [k if len(k := key_of(x)) >= min_chars else "" for x in (text or "").split("\n")]


def hash_keys(keys: list[str]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest as h
    return np.array([h(k.encode("utf-8", "surrogatepass")) for k in keys], dtype=np.uint64)


def positions(h: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions (len(h), PROBES) by double hashing; bits is a power of two."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    i = np.arange(PROBES, dtype=np.uint64)
    return (h[:, None] + i * step[:, None]) & np.uint64(bits - 1)


def _pack(bits: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), dtype=np.uint8)


def filter_bits(docs: DataFrame, bits_per_line: int, max_bits: int) -> int:
    lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"))) + 1
    n = docs.agg(F.sum(lines)).first()[0] or 1
    return int(min(max_bits, max(SEGMENT, 1 << int(np.ceil(np.log2(n * bits_per_line))))))


def twice_filter(docs: DataFrame, bits: int, min_chars: int) -> np.ndarray:
    """The merged twice filter as packed bits."""
    @lean("linededup")
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        once, twice = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for b in batches:
            ids = b.column(0).to_pylist()
            found = [(i, k) for i, t in zip(ids, b.column(1).to_pylist())
                     for k in set(keys_of(t, min_chars)) if k]
            h = hash_keys([k for _, k in found])
            # a pair (document, key) counts once, also if a document has several rows
            own = np.array([NO_ID if i is None else i for i, _ in found], dtype=np.int64)
            pairs = np.unique(np.stack([h, own.view(np.uint64)]), axis=1)[0] if len(h) else h
            u, n = np.unique(pairs, return_counts=True)
            twice = np.union1d(twice, np.concatenate([u[n > 1], np.intersect1d(u, once, assume_unique=True)]))
            once = np.union1d(once, u)
        p1, p2 = np.unique(positions(once, bits)), np.unique(positions(twice, bits))
        part = TaskContext.get().partitionId()
        e1 = np.searchsorted(p1, np.arange(0, bits + 1, SEGMENT, dtype=np.uint64))
        e2 = np.searchsorted(p2, np.arange(0, bits + 1, SEGMENT, dtype=np.uint64))
        rows: list[tuple] = []
        for s in range(bits // SEGMENT):
            if e1[s + 1] > e1[s]:
                packed = []
                for p, e in ((p1, e1), (p2, e2)):
                    x = np.zeros(SEGMENT, dtype=bool)
                    x[(p[e[s]:e[s + 1]] - np.uint64(s * SEGMENT)).astype(np.int64)] = True
                    packed.append(_pack(x))
                rows.append((s, part, *packed))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
            names=["segment", "part", "once", "twice"])

    def merge(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(SEGMENT // 8, np.uint8), np.zeros(SEGMENT // 8, np.uint8)
        for o, t in zip(g["once"], g["twice"]):
            o, t = _unpack(o), _unpack(t)
            twice |= t | (once & o)
            once |= o
        return pd.DataFrame({"segment": [key[0]], "part": [key[1]], "once": [zlib.compress(once.tobytes(), 1)],
                             "twice": [zlib.compress(twice.tobytes(), 1)]})

    schema = "segment int, part int, once binary, twice binary"
    filters = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(partial, schema)
    parts = docs.rdd.getNumPartitions()
    while True:
        filters = filters.withColumn("part", (F.col("part") / FAN_IN).cast("int"))
        filters = filters.groupBy("segment", "part").applyInPandas(merge, schema)
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            break
    out = np.zeros(bits // 8, np.uint8)
    for r in filters.select("segment", "twice").toLocalIterator():
        out[r.segment * SEGMENT // 8:(r.segment + 1) * SEGMENT // 8] = _unpack(r.twice)
    return out


def repeated_keys(docs: DataFrame, min_chars: int = MIN_CHARS, bits_per_line: int = 10,
                  max_bits: int = 1 << 30) -> DataFrame:
    """(doc_id, key) of every key to be dropped from a document: repeated keys
    in all holders but the first."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    bits = filter_bits(docs, bits_per_line, max_bits)
    shared = docs.sparkSession.sparkContext.broadcast(twice_filter(docs, bits, min_chars))

    @lean("linededup")
    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = shared.value
        for b in sliced(batches):
            ids, keys = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                mine = [k for k in dict.fromkeys(keys_of(t, min_chars)) if k]
                ids += [i] * len(mine)
                keys += mine
            p = positions(hash_keys(keys), bits)
            hit = ((twice[(p >> np.uint64(3)).astype(np.int64)] >> (7 - (p & np.uint64(7)).astype(np.uint8))) & 1).all(axis=1)
            at = np.flatnonzero(hit)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[j] for j in at], pa.int64()), pa.array([keys[j] for j in at], pa.string())],
                names=["doc_id", "key"])

    # both tables are stored, so that the join of a frequent key can be split
    found = stored(docs.mapInArrow(suspects, "doc_id long, key string"), "line-suspects")
    first = found.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first = stored(first.where(F.col("first") < F.col("last")).select("key", "first"), "line-repeats")
    return found.join(first, "key").where(F.col("doc_id") > F.col("first")).select("doc_id", "key")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, bits_per_line: int = 10,
                max_bits: int = 1 << 30) -> DataFrame:
    """``docs`` with text reduced to the lines that stay, and n_lines (before)
    and n_dropped.  Columns of those names are replaced."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = docs.select(*(F.col(f"`{c}`") for c in names))
    drops = repeated_keys(docs, min_chars, bits_per_line, max_bits)
    drops = drops.groupBy("doc_id").agg(F.collect_set("key").alias("_drop")).withColumnRenamed("doc_id", "_doc")
    joined = docs.join(drops, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == F.col("_doc"), "left").drop("_doc")
    at = names.index("text")

    @lean("linededup")
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts, total, gone = [], [], []
            for t, drop in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist()):
                lines = (t or "").split("\n")
                stay = lines
                if drop:
                    drop = set(drop)
                    stay = [x for x, k in zip(lines, keys_of(t, min_chars)) if k not in drop]
                texts.append("\n".join(stay))
                total.append(len(lines))
                gone.append(len(lines) - len(stay))
            cols = list(b.columns[:len(names)])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(gone, pa.int64())],
                                             names=[*names, "n_lines", "n_dropped"])

    schema = ", ".join(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}"
                       for f in docs.schema.fields)
    return joined.mapInArrow(cut, f"{schema}, n_lines long, n_dropped long")
