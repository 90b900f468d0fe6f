"""Centroid clustering with heap-ordered bounds.

Lloyd's rounds on integer vectors, exact at every step.  A vector assigned to
cluster c has a gap: its distance to the second nearest centroid minus that to
its own.  When centroids move, the gap shrinks by at most the move of c plus the
largest move of any other, the cluster's drift.  So each cluster keeps a heap of
(gap + drift so far when pushed): after a round only the vectors at the top of
the heap whose key is at or below the cluster's accumulated drift are popped and
exactly rescanned; all others keep their cluster without being looked at.

Vectors live in blocks of ``BLOCK`` rows, one table row each: ids, components in
the narrowest integer type, clusters, and a heap per cluster.  A round maps over
the blocks and writes them anew under the shared folder, so nothing is shuffled
but (clusters x components) sums of what changed, and a lost executor repeats only
its blocks of one round.  Centroids are k x dim integers whatever the input.

Gaps are kept a little too small and drifts a little too large (``SLACK``), far
more than the rounding of floating point, so ties and near-ties are rescanned;
distances are compared as integers, ties going to the smaller number.

Defined results: vectors of another length, or with a null or non-finite
component, are left out; rows of one vec_id are vectors of their own; a null
vec_id is kept and becomes a first centroid only when other ids run out (equal
ids: by components); with fewer vectors than k there are as many clusters as
vectors; an empty table stays empty; other columns are ignored.  Components whose
squared distances would leave 64 bits raise an error.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm.common import sliced, stored

BLOCK = 4096
SLACK = 1e-12
STATE = ("ids array<long>, width int, vectors binary, cluster binary, heap_size array<int>, heap_key binary, "
         "heap_row binary, delta array<long>, scanned long")


def integer_vectors(df: DataFrame, dim: int, scale: int, column: str = "embedding") -> DataFrame:
    """(vec_id, v): the kept vectors as floor(scale * component)."""
    limit = int(math.isqrt((1 << 62) // dim)) // 2
    x = F.col(column).cast("array<double>")
    good = (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.when(F.abs(c * scale) < limit, F.floor(c * scale)).otherwise(
        F.raise_error(F.lit(f"a component times {scale} is beyond {limit}")).cast("long")))
    return df.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``1:<vec_id>``, in that order."""
    h = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h")
    rows = vectors.select(h, "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64) if rows else np.zeros((0, 0), np.int64)


def narrow(v: np.ndarray) -> np.ndarray:
    most = int(np.abs(v).max(initial=0))
    return v.astype(next(t for t, m in (("<i1", 127), ("<i2", 32767), ("<i4", 2**31 - 1), ("<i8", 2**63 - 1)) if most <= m))


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (vectors, centroids) as int64."""
    v = v.astype(np.int64)
    most = int(np.abs(v).max(initial=0)) + int(np.abs(centroids).max(initial=0))
    if most * most * max(1, centroids.shape[1]) < 1 << 52:  # every sum is an exact double
        dot = (v.astype(np.float64) @ centroids.T.astype(np.float64)).astype(np.int64)
        return (v * v).sum(axis=1)[:, None] - 2 * dot + (centroids * centroids).sum(axis=1)
    return np.stack([((v - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def scan(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each vector (ties: the smaller) and its gap, rounded down."""
    d = squared(v, centroids)
    own = d.argmin(axis=1).astype(np.int32)
    if d.shape[1] == 1:
        return own, np.full(len(v), np.inf)
    at = np.arange(len(v))
    best = np.sqrt(d[at, own].astype(np.float64))
    d[at, own] = np.iinfo(np.int64).max
    second = np.sqrt(d.min(axis=1).astype(np.float64))
    return own, second * (1 - SLACK) - best * (1 + SLACK)


def drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """By how much a round may shrink the gaps of each cluster, rounded up."""
    move = np.sqrt(((new - old).astype(object) ** 2).sum(axis=1).astype(np.float64)) if len(old) else np.zeros(0)
    others = np.array([np.delete(move, c).max(initial=0.0) for c in range(len(move))])
    return (move + others) * (1 + 4 * SLACK)


def block_row(ids, v: np.ndarray, own: np.ndarray, heaps: list, delta: np.ndarray, scanned: int) -> tuple:
    keys = np.concatenate([np.array([x[0] for x in h], "<f8") if isinstance(h, list) else h[0] for h in heaps])
    rows = np.concatenate([np.array([x[1] for x in h], "<i4") if isinstance(h, list) else h[1] for h in heaps])
    sizes = [len(h) if isinstance(h, list) else len(h[0]) for h in heaps]
    return (ids, v.dtype.itemsize, v.tobytes(), own.astype("<i4").tobytes(), sizes, keys.astype("<f8").tobytes(),
            rows.astype("<i4").tobytes(), delta.ravel().tolist(), scanned)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.binary(),
             pa.list_(pa.int64()), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)],
                                      names=[c.split()[0] for c in STATE.split(", ")])


def changes(v: np.ndarray, own: np.ndarray, k: int, sign: int = 1) -> np.ndarray:
    """Sums of the vectors of each cluster, and their number in the last column."""
    out = np.zeros((k, v.shape[1] + 1), np.int64)
    np.add.at(out, own, np.concatenate([v.astype(np.int64), np.ones((len(v), 1), np.int64)], axis=1) * sign)
    return out


def begin(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Blocks with every vector scanned once and pushed on the heap of its cluster."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, BLOCK):
            if not b.num_rows:
                continue
            v = narrow(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            own, gap = scan(v, centroids)
            heaps = [list(zip(gap[own == c].tolist(), np.flatnonzero(own == c).tolist())) for c in range(k)]
            for h in heaps:
                heapq.heapify(h)
            yield as_batch([block_row(b.column(0).to_pylist(), v, own, heaps, changes(v, own, k), len(v))])

    return vectors.mapInArrow(run, STATE)


def unpack(r: dict, dim: int) -> tuple[np.ndarray, np.ndarray]:
    v = np.frombuffer(r["vectors"], f"<i{r['width']}").reshape(-1, dim)
    return v, np.frombuffer(r["cluster"], "<i4").copy()


def advance(state: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """The blocks after the next assignment: expired tops popped, rescanned and
    pushed again.  ``drift`` is each cluster's sum over all rounds so far."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            r = b.to_pylist()[0]
            v, own = unpack(r, dim)
            keys, rows = np.frombuffer(r["heap_key"], "<f8"), np.frombuffer(r["heap_row"], "<i4")
            ends = np.cumsum(r["heap_size"])
            heaps: list = []
            popped: list[int] = []
            for c, (end, n) in enumerate(zip(ends.tolist(), r["heap_size"])):
                h = keys[end - n:end], rows[end - n:end]
                if n and h[0][0] <= drift[c]:  # else the heap is passed on as it is
                    h = list(zip(h[0].tolist(), h[1].tolist()))
                    while h and h[0][0] <= drift[c]:
                        popped.append(heapq.heappop(h)[1])
                heaps.append(h)
            at = np.array(popped, dtype=np.int64)
            delta = np.zeros((k, dim + 1), np.int64)
            if len(at):
                new, gap = scan(v[at], centroids)
                moved = new != own[at]
                delta = changes(v[at][moved], new[moved], k) + changes(v[at][moved], own[at][moved], k, -1)
                own[at] = new
                for i, c, key in zip(popped, new.tolist(), (gap + drift[new]).tolist()):
                    if not isinstance(heaps[c], list):
                        heaps[c] = list(zip(heaps[c][0].tolist(), heaps[c][1].tolist()))
                    heapq.heappush(heaps[c], (key, i))
            yield as_batch([block_row(r["ids"], v, own, heaps, delta, len(at))])

    return state.mapInArrow(run, STATE)


def total_changes(state: DataFrame, k: int, dim: int) -> list[list[int]]:
    """Sums over all blocks: k x (dim + 1) numbers, exact."""
    rows = state.select(F.posexplode("delta").alias("at", "x")).groupBy("at").agg(
        F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    out = [[0] * (dim + 1) for _ in range(k)]
    for r in rows:
        out[r["at"] // (dim + 1)][r["at"] % (dim + 1)] = int(r["x"])
    return out


def members(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            r = b.to_pylist()[0]
            v, own = unpack(r, dim)
            d = ((v.astype(np.int64) - centroids[own]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(own), pa.array(d)],
                                             names=["vec_id", "cluster", "distance"])

    return state.select("ids", "width", "vectors", "cluster").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64,
            column: str = "embedding") -> tuple[DataFrame, np.ndarray, list[int]]:
    """(vec_id, cluster, distance) of the kept vectors, the final centroids, and how
    many vectors each assignment scanned."""
    spark = df.sparkSession
    vectors = integer_vectors(df, dim, scale, column)
    centroids = first_centroids(vectors, k)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids, []
    k = len(centroids)
    state = stored(begin(vectors, centroids), "centroids-blocks")
    sums = [[0] * (dim + 1) for _ in range(k)]
    drift = np.zeros(k)
    scanned = []
    for _ in range(rounds):
        scanned.append(state.agg(F.sum("scanned")).first()[0])
        sums = [[a + b for a, b in zip(x, y)] for x, y in zip(sums, total_changes(state, k, dim))]
        new = np.array([[s // x[-1] for s in x[:-1]] if x[-1] else c for x, c in zip(sums, centroids.tolist())], dtype=np.int64)
        drift = drift + drifts(centroids, new)
        centroids = new
        state = stored(advance(state, centroids, drift), "centroids-blocks")
    scanned.append(state.agg(F.sum("scanned")).first()[0])
    return members(state, centroids), centroids, scanned


def cluster_digests(df: DataFrame, **settings) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    import hashlib
    out, centroids, _ = cluster(df, **settings)
    out = stored(out, "centroids-members")
    per = {r["cluster"]: int(r["d"]) for r in out.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    rows = [(c, per[c], sum(per.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
            for c in sorted(per)]
    table = df.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(table), "cluster").select(  # k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
