"""MinHash near-duplicates by a multi-index Hamming join.

A text's set of word shingles is hashed to a signature of ``SYMBOLS`` MinHash
values of b bits: 16 for the first ``INDEXED``, 8 for the rest.  The indexed
symbols are split into chunks.  Of two signatures with a Hamming distance of at
most 2 * chunks - 1, a chunk must (by the pigeonhole principle) differ in one
symbol at most, and every chunk is indexed under all its one-symbol deletions.
So all pairs under that distance share a key; the number of chunks follows from
the similarity threshold (``chunks_for``), which a pair exactly at the threshold
exceeds with a probability of about 1e-5 and one above it far more rarely.
Candidates are then compared on the whole signature and confirmed on the full
sets.

Texts with equal sets are one vertex from the start.  Buckets never
expand into all pairs:

1. Each bucket links its members to its least one (first inside a block of
   signatures, then one row per block and key meets in ranges of the key space).
   Confirmed links give components.
2. Buckets that still hold several components compare the signatures of
   members outside their main component with all others (large buckets in
   fragments).  Texts that candidate pairs join form clusters; only one edge per
   text leaves a bucket.
3. Inside a cluster, every candidate pair of two components is confirmed on the full
   sets (large clusters in fragments that meet two by two), and links that merge
   components are kept.  No candidate pair of two components stays untested, so
   the final components are those of all links.

Sets are compared as 48 bits of their shingle hashes (a false match in a pair has a
probability of about 1e-9).

Defined results: null texts and texts without words have an empty set and
link with nothing; with fewer words than a shingle the whole sequence is one;
rows of one doc_id are one document, linked if any of its texts is; a null
doc_id is linked with nothing, has no component and is kept; other columns
stay; an empty table stays empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm.common import WordHashes, lean, mix64, shingles, sliced, stored
from grove.llm.components import components

SYMBOLS = 256
INDEXED = 64
WIDTH = SYMBOLS + INDEXED  # bytes: low bytes of all symbols, high bytes of the indexed
FRAGMENT = 4000  # members of a bucket in each of two groups compared by signature
MEET = 1000  # members of a cluster in each of two groups compared by their sets
MEET_BYTES = 8 << 20  # packed sets of such a group, about
RANGE_ROWS = 500_000
STEP = 16_384  # signature pairs compared at once
LIVE_BITS = 27  # bits (as a power of two) of the bitmap of keys with several members: 16 MB

_rng = np.random.default_rng(20240501)
_A = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2)
_SALT = _rng.integers(0, 1 << 63, INDEXED, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_BIG = np.iinfo(np.int64).max

_WORDS = WordHashes("neardup", 200_000)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text (A-Z lower-cased, ASCII words)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return np.unique(shingles(_WORDS(words), n))


def signature(s: np.ndarray) -> np.ndarray:
    """WIDTH bytes; long sets go through in steps, to bound memory."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(s), 1024):
        np.minimum(least, ((s[i:i + 1024, None] ^ _B) * _A).min(axis=0), out=least)
    h = least * _P
    return np.concatenate([h >> np.uint64(56), h[:INDEXED] >> np.uint64(48) & np.uint64(255)]).astype(np.uint8)


def keys_of(sig: np.ndarray, chunks: int) -> np.ndarray:
    """Bucket keys (rows, INDEXED): key i is the chunk of symbol i without it."""
    place = np.arange(INDEXED, dtype=np.uint64) << np.uint64(16)
    z = mix64(place + sig[:, :INDEXED] + (sig[:, SYMBOLS:].astype(np.uint64) << np.uint64(8)) + _P)
    chunk = np.arange(INDEXED) * chunks // INDEXED
    total = np.add.reduceat(z, np.searchsorted(chunk, np.arange(chunks)), axis=1)
    return (total[:, chunk] - z) ^ _SALT


def distance(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Number of differing symbols (by their low bytes), row by row."""
    return (s[:, :SYMBOLS] != t[:, :SYMBOLS]).sum(axis=1)


def close_pairs(sig: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Whether the signatures of each pair of rows are close, in steps to bound memory."""
    ok = np.zeros(len(a), dtype=bool)
    for i in range(0, len(a), STEP):
        ok[i:i + STEP] = distance(sig[a[i:i + STEP]], sig[b[i:i + STEP]]) <= radius
    return ok


def pack_set(s: np.ndarray) -> bytes:
    return (s >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack_set(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def max_distance(threshold: float, symbols: int) -> int:
    """Hamming distance that a pair at the similarity threshold exceeds with a
    probability of about 1e-5 at most (4.75 standard deviations)."""
    p = 1 - threshold
    return int(symbols * p + 4.75 * np.sqrt(symbols * p * (1 - p)))


def chunks_for(threshold: float) -> int:
    """Least number of chunks whose guaranteed distance covers the threshold."""
    chunks = max_distance(threshold, INDEXED) // 2 + 1
    if 3 * chunks > INDEXED:
        raise ValueError(f"a similarity of {threshold} is too low for {INDEXED} indexed symbols")
    return chunks


def signed(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, sig) of each row."""
    from xxhash import xxh3_128_digest

    @lean("neardup")  # the worker goes on to stages without texts
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            size, ids, sigs = [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, n)
                size.append(len(s))
                ids.append(xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(ids, pa.binary()), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "set_id", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_shingles long, set_id binary, sig binary")


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each row's run in sorted keys, and whether the run has several rows."""
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[start, len(keys)])
    return np.repeat(start, size), np.repeat(size > 1, size)


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs once each, the smaller first."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)



def bucket_rows(sigs: DataFrame, chunks: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """From stored (id, sig): star pairs (a, b) of all buckets, and the members
    (key, id) of all buckets with several members."""
    rows = sigs.count() * INDEXED
    ranges = max(1, -(-rows // RANGE_ROWS))

    def sorted_rows(b: pa.RecordBatch):
        ids = b.column(0).to_numpy()
        sig = _matrix(b.column(1), WIDTH)
        keys = keys_of(sig, chunks).ravel()
        who = np.repeat(np.arange(len(ids)), INDEXED)
        order = np.lexsort((ids[who], keys))
        return ids, sig, keys[order], who[order]

    @lean("neardup")
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Star pairs inside a block."""
        for b in batches:
            ids, sig, keys, who = sorted_rows(b)
            start, _ = _runs(keys)
            a, c = _pairs(who, who[start])
            near = np.flatnonzero(a != c)
            a, c = a[near], c[near]
            ok = close_pairs(sig, a, c, radius)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a[ok]]), pa.array(ids[c[ok]])], names=["a", "b"])

    @lean("neardup")
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each key of a block once, with its least member, by range."""
        from pyspark import TaskContext
        part, made = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            ids, _, keys, who = sorted_rows(b)
            start, several = _runs(keys)
            at = np.unique(start)
            k, least, many = keys[at], ids[who[at]], several[at]
            cut = np.searchsorted(((k >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64), np.arange(ranges + 1))
            use = [r for r in range(ranges) if cut[r + 1] > cut[r]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(use, pa.int32()), pa.array([part + made] * len(use), pa.int64()),
                 *(pa.array([x[cut[r]:cut[r + 1]].tobytes() for r in use], pa.binary()) for x in (k, least, many))],
                names=["range", "block", "keys", "ids", "many"])
            made += 1

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        """Stars of the blocks' least members; which keys have several members."""
        every = [np.frombuffer(x, "<u8") for x in g["keys"]]
        keys, ids = np.concatenate(every), np.concatenate([np.frombuffer(x, "<i8") for x in g["ids"]])
        many = np.concatenate([np.frombuffer(x, bool) for x in g["many"]])
        order = np.lexsort((ids, keys))
        start, several = _runs(keys[order])
        a, b = _pairs(ids[order], ids[order][start])
        far = a != b
        live = np.unique(keys[order][several | many[order]])
        at = (live >> np.uint64(64 - LIVE_BITS)).astype(np.int64)
        first = int(at[0]) >> 3 if len(at) else 0
        bits = np.zeros(((int(at[-1]) >> 3) - first + 1) * 8 if len(at) else 0, dtype=bool)
        bits[at - 8 * first] = True
        return pd.DataFrame({"a": [a[far].astype("<i8").tobytes()], "b": [b[far].astype("<i8").tobytes()],
                             "keys": [live.astype("<u8").tobytes()], "first": [first],
                             "bits": [zlib.compress(np.packbits(bits).tobytes(), 1)]})

    @lean("neardup")
    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(v, "<i8")) for v in (x, y)], names=["a", "b"])

    @lean("neardup")
    def unfold_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, "<i8"))], names=["key"])

    @lean("neardup")
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            keys = keys_of(_matrix(b.column(1), WIDTH), chunks).ravel()
            at = (keys >> np.uint64(64 - LIVE_BITS)).astype(np.int64)
            may = (shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            yield pa.RecordBatch.from_arrays([pa.array(keys[may].view(np.int64)), pa.array(np.repeat(ids, INDEXED)[may])],
                                             names=["key", "id"])

    met = stored(sigs.mapInArrow(ask, "range int, block long, keys binary, ids binary, many binary").groupBy(
        "range").applyInPandas(meet, "a binary, b binary, keys binary, first long, bits binary"), "near-stars")
    # a bitmap of fixed size keeps most rows of single members from the exact join below
    bitmap = np.zeros(1 << (LIVE_BITS - 3), np.uint8)
    for r in met.select("first", "bits").toLocalIterator():
        part = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
        bitmap[r["first"]:r["first"] + len(part)] |= part
    shared = sigs.sparkSession.sparkContext.broadcast(bitmap)
    inside = sigs.mapInArrow(local, "a long, b long")
    across = met.select("a", "b").mapInArrow(unfold, "a long, b long").distinct()
    across = across.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("s")), "a").join(
        sigs.select(F.col("id").alias("b"), F.col("sig").alias("t")), "b").select("a", "b", "s", "t")

    @lean("neardup")
    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = distance(_matrix(b.column(2), WIDTH), _matrix(b.column(3), WIDTH)) <= radius
            yield b.select(["a", "b"]).filter(pa.array(ok))

    stars = inside.unionByName(across.mapInArrow(close, "a long, b long")).distinct()
    # a number of partitions of their own: these rows compress so well that few would be
    # made by their bytes, and sorting them would fill an executor
    parts = max(ranges, int(sigs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    live = met.select("keys").mapInArrow(unfold_keys, "key long").repartition(parts, "key")
    rows = sigs.mapInArrow(members, "key long, id long").repartition(parts, "key").join(live, "key", "left_semi")
    return stars, rows


def candidate_clusters(rows: DataFrame, comps: DataFrame, sigs: DataFrame, radius: int) -> DataFrame:
    """(id, component): nodes that are joined by candidate pairs across link
    components share a cluster.  From the bucket members ``rows`` (key, id) and
    ``comps`` (id, component, size); pairs themselves are never listed."""
    # ids without a link yet are their own component
    mine = rows.join(comps, "id", "left").select(
        "key", "id", F.coalesce("component", "id").alias("component"), F.coalesce("size", F.lit(1)).alias("size"))
    per = mine.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"),
                                  F.max(F.struct("size", "component")).getField("component").alias("main"))
    open_ = mine.join(per.where(F.col("lo") < F.col("hi")).select("key", "n", "main"), "key")
    # all members and those outside the main component are cut into fragments, and
    # every fragment of the ones meets every fragment of the others
    cuts = F.ceil(F.col("n") / FRAGMENT).cast("long")
    outside = F.count(F.when(F.col("component") != F.col("main"), 1))
    open_ = open_.join(open_.groupBy("key").agg(F.ceil(outside / FRAGMENT).cast("long").alias("across")), "key")
    mine = lambda n: F.pmod(F.xxhash64("id"), n)
    left = open_.select("key", "id", "component", F.lit(0).alias("right"), F.explode(F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("across") - 1), lambda j: mine(cuts) * F.col("across") + j)).alias("cut"))
    right = open_.where(F.col("component") != F.col("main")).select("key", "id", "component", F.lit(1).alias("right"), F.explode(
        F.transform(F.sequence(F.lit(0).cast("long"), cuts - 1), lambda i: i * F.col("across") + mine(F.col("across")))).alias("cut"))
    every = left.unionByName(right).join(sigs, "id")
    every = every.repartition("key", "cut").sortWithinPartitions("key", "cut", "right", "id")

    def joined(ids, comp, right, sig) -> tuple[np.ndarray, np.ndarray]:
        """(id, least id reached) over the candidate pairs of one fragment."""
        lt, rt = np.flatnonzero(right == 0), np.flatnonzero(right == 1)
        if not len(rt) or not len(lt):
            return ids[:0], ids[:0]
        near = np.zeros((len(rt), len(lt)), dtype=bool)
        step = max(1, 8_000_000 // (SYMBOLS * len(lt)))
        for i in range(0, len(rt), step):
            r = rt[i:i + step]
            differ = (sig[r, None, :SYMBOLS] != sig[None, lt, :SYMBOLS]).sum(axis=2, dtype=np.uint16)
            near[i:i + step] = (differ <= radius) & (comp[r][:, None] != comp[lt])
        a, b = ids[rt].copy(), ids[lt].copy()  # least id reached so far, by row and by column
        rows, cols = near.any(axis=1), near.any(axis=0)
        step = max(1, 1_000_000 // len(lt))
        changed = bool(rows.any())
        while changed:
            before = a.copy(), b.copy()
            for i in range(0, len(rt), step):
                part = near[i:i + step]
                a[i:i + step] = np.minimum(a[i:i + step], np.where(part, b, _BIG).min(axis=1))
                b = np.minimum(b, np.where(part, a[i:i + step, None], _BIG).min(axis=0))
            changed = not ((before[0] == a).all() and (before[1] == b).all())
        node, low = np.r_[ids[rt][rows], ids[lt][cols]], np.r_[a[rows], b[cols]]
        return node[node != low], low[node != low]

    @lean("neardup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(t: pa.Table) -> pa.RecordBatch:
            key, cut = t["key"].to_numpy(), t["cut"].to_numpy()
            ids, comp, right = (t[c].to_numpy() for c in ("id", "component", "right"))
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(-1, WIDTH)
            start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (cut[1:] != cut[:-1])]) if len(key) else np.zeros(0, int)
            found = [joined(ids[s:e], comp[s:e], right[s:e], sig[s:e]) for s, e in zip(start, np.r_[start[1:], len(key)])]
            a, b = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
            if len(a):
                a, b = np.unique(np.stack([a, b]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for b in batches:
            # hold back the last fragment: it may go on in the next batch
            held.append(b)
            t = pa.Table.from_batches(held)
            key, cut = t["key"].to_numpy(), t["cut"].to_numpy()
            if not len(key):
                continue
            last = int(np.flatnonzero((key == key[-1]) & (cut == cut[-1]))[0])
            if last:
                yield flush(t.slice(0, last))
            held = t.slice(last).combine_chunks().to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    return components(every.select("key", "cut", "id", "component", "right", "sig").mapInArrow(run, "a long, b long"))


def sets_of(docs: DataFrame, needed: DataFrame, n: int) -> DataFrame:
    """Stored (id, s): the packed shingle sets of the rows whose id is in ``needed``."""
    @lean("neardup")
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([pack_set(shingle_set(t, n)) for t in b.column(1).to_pylist()], pa.binary())],
                names=["id", "s"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return stored(texts.join(needed, "id", "left_semi").mapInArrow(sets, "id long, s binary"), "near-sets")


def links_across(clusters: DataFrame, comps: DataFrame, sigs: DataFrame, docs: DataFrame, n: int, per_cent: int,
                 radius: int) -> DataFrame:
    """Links (a, b) that join the link components inside each cluster.  A cluster is
    cut into fragments of ``MEET`` members; every two of them meet once, so that
    a text's set travels once per fragment, not once per pair."""
    clusters = stored(clusters.withColumnRenamed("component", "cluster"), "near-clusters")
    sets = sets_of(docs, clusters.select("id"), n)
    sized = clusters.join(sets.select("id", F.length("s").alias("bytes")), "id")
    cuts = sized.groupBy("cluster").agg(F.ceil(F.greatest(
        F.count(F.lit(1)) / MEET, F.sum("bytes") / MEET_BYTES)).cast("int").alias("cuts"))
    rows = clusters.join(cuts, "cluster").join(comps.select("id", "component"), "id", "left").select(
        "cluster", "id", F.coalesce("component", "id").alias("component"), F.pmod(F.hash("id"), F.col("cuts")).alias("cut"), "cuts")
    rows = rows.join(sigs, "id").join(sets, "id")
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other")
    rows = rows.select("cluster", "id", "component", "cut", "sig", "s", other)
    rows = rows.withColumn("i", F.least("cut", "other")).withColumn("j", F.greatest("cut", "other"))

    def meet(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        ids, comp, cut = (g[c].to_numpy() for c in ("id", "component", "cut"))
        sig = np.frombuffer(b"".join(g["sig"]), np.uint8).reshape(-1, WIDTH)[:, :SYMBOLS]
        sets = [unpack_set(s) for s in g["s"]]
        size = np.array([len(s) for s in sets])
        dense = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.zeros(0, int)
        ends = np.cumsum(size)
        sets = [dense[e - k:e] for e, k in zip(ends, size)]
        mark = np.zeros(int(dense.max()) + 1 if len(dense) else 0, dtype=bool)
        root = comp.copy()  # link components merge as links are found
        out = []
        for x in range(len(ids)):
            y = np.flatnonzero(root != root[x])
            y = y[y > x] if key[1] == key[2] else y[cut[y] != cut[x]] if cut[x] == key[1] else y[:0]
            y = y[100 * np.minimum(size[y], size[x]) >= per_cent * np.maximum(size[y], size[x])]
            y = y[(sig[y] != sig[x]).sum(axis=1) <= radius] if len(y) else y
            if not len(y):
                continue
            mark[sets[x]] = True
            common = np.add.reduceat(mark[np.concatenate([sets[k] for k in y])], np.cumsum(size[y]) - size[y], dtype=np.int64)
            mark[sets[x]] = False
            for k in y[100 * common >= per_cent * (size[y] + size[x] - common)].tolist():
                if root[k] != root[x]:
                    out.append((min(ids[x], ids[k]), max(ids[x], ids[k])))
                    root[root == root[k]] = root[x]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.groupBy("cluster", "i", "j").applyInPandas(meet, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, n: int, per_cent: int) -> DataFrame:
    """Those of ``pairs`` (a, b; stored) whose full sets are similar enough."""
    found = sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), n)
    both = pairs.join(found.withColumnRenamed("id", "b").withColumnRenamed("s", "t"), "b").join(
        found.withColumnRenamed("id", "a"), "a").select("a", "b", "s", "t")

    @lean("neardup")
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            ok = []
            for s, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = len(s) // 6, len(t) // 6
                if 100 * min(x, y) < per_cent * max(x, y):
                    ok.append(False)
                    continue
                common = x + y - len(np.unique(np.concatenate([unpack_set(s), unpack_set(t)])))
                ok.append(x > 0 and 100 * common >= per_cent * (x + y - common))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 5, per_cent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``; links
    need 100 * intersection >= per_cent * union of the ``n``-word shingle sets."""
    chunks = chunks_for(per_cent / 100)
    radius = max_distance(per_cent / 100, SYMBOLS)
    rows = stored(signed(docs, n), "near-signed")
    some = rows.where(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull())
    # stored, so that the join of a set with very many copies can be split
    reps = stored(some.groupBy("set_id").agg(F.min("doc_id").alias("id")), "near-reps")
    sigs = some.join(reps.withColumnRenamed("id", "rep"), "set_id").where(F.col("doc_id") == F.col("rep"))
    sigs = stored(sigs.select(F.col("doc_id").alias("id"), "sig").dropDuplicates(["id", "sig"]), "near-sigs")

    stars, members = bucket_rows(sigs, chunks, radius)
    links = stored(confirmed(stored(stars, "near-pairs"), docs, n, per_cent), "near-links")
    comps = components(links)
    sizes = comps.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    comps = stored(comps.join(sizes, "component").select("id", "component", "size"), "near-comps")
    clusters = candidate_clusters(members, comps, sigs, radius)
    rest = stored(links_across(clusters, comps, sigs, docs, n, per_cent, radius), "near-links")
    # rows of one doc_id are one document: all its sets are linked to its least representative
    many = some.groupBy("doc_id").agg(F.min("set_id").alias("x"), F.max("set_id").alias("y")).where("x < y").select("doc_id")
    held = some.join(stored(many, "near-many"), "doc_id").select("doc_id", "set_id").distinct().join(
        reps.withColumnRenamed("id", "rep"), "set_id").select("doc_id", "rep")
    first = held.groupBy("doc_id").agg(F.min("rep").alias("b"))
    same = held.join(first, "doc_id").where(F.col("rep") != F.col("b")).select(F.col("rep").alias("a"), "b").distinct()
    final = components(links.unionByName(rest).unionByName(same)).withColumnRenamed("id", "rep")

    out = rows.join(reps.withColumnRenamed("id", "rep"), "set_id", "left")
    out = out.join(final, "rep", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
