import hashlib
import math

import numpy as np
import pytest

from grove.llm import centroids as C

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance string, v string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, "e", "e", "e") for i, v in rows], SCHEMA).repartition(parts)


def brute(rows, k, rounds, dim, scale):
    """Lloyd's rounds over plain integers."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(((i is None, "" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept))
    cents = [v for _, _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cents = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(cents)]
    got = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = sum(d for *_, d in got)
    per = {}
    for _, c, d in got:
        per[c] = per.get(c, 0) + d
    return sorted(((i, c, d, per[c], inertia, hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest())
                   for i, c, d in got), key=str)


def got(df, **kw):
    return sorted((tuple(r) for r in C.cluster_digests(df, **kw).collect()), key=str)


def points(rng, n, dim, centres=12, spread=0.15):
    mid = rng.normal(size=(centres, dim))
    return [(i, [float(np.float32(x)) for x in mid[i % centres] + spread * rng.normal(size=dim)]) for i in range(n)]


def edge_rows(rng, dim):
    """Ties, copies, bad vectors, null and repeated ids."""
    same = [0.25] * dim
    rows = points(rng, 300, dim) + [(1000 + i, same) for i in range(40)] + [(5, same), (5, same), (None, same), (None, [1.0] * dim)]
    rows += [(2000, None), (2001, [0.0] * (dim - 1)), (2002, [0.0] * (dim + 1)), (2003, [None] + [0.0] * (dim - 1)),
             (2004, [float("nan")] + [0.0] * (dim - 1)), (2005, [float("-inf")] + [0.0] * (dim - 1)), (2006, [])]
    return rows + [(3000 + i, [float(x) for x in rng.integers(-1, 2, dim)]) for i in range(100)]  # many equal distances


@pytest.mark.parametrize("k,dim,scale,rounds", [(16, 8, 64, 3), (5, 3, 2, 6), (1, 4, 64, 2), (16, 64, 64, 3)])
def test_equals_plain_rounds(spark, monkeypatch, k, dim, scale, rounds):
    monkeypatch.setattr(C, "BLOCK", 50)
    rows = edge_rows(np.random.default_rng(k), dim)
    assert got(frame(spark, rows), k=k, rounds=rounds, dim=dim, scale=scale) == brute(rows, k, rounds, dim, scale)


def test_large_components(spark):
    """Where products leave the exact doubles, integers decide."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6) * 400_000]) for i in range(200)]
    assert got(frame(spark, rows), k=7, rounds=4, dim=6, scale=64) == brute(rows, 7, 4, 6, 64)
    with pytest.raises(Exception, match="beyond"):
        C.cluster_digests(frame(spark, [(1, [1e30] * 6)]), k=2, dim=6).collect()


def test_heaps_leave_most_vectors_alone(spark):
    rows = points(np.random.default_rng(1), 3000, 16)
    _, _, scanned = C.cluster(frame(spark, rows), k=12, rounds=6, dim=16)
    assert scanned[0] == 3000 and len(scanned) == 7 and max(scanned[4:]) < 1000


def test_heap_order_and_bounds():
    """Keys form a heap, and a gap never exceeds the true one."""
    rng = np.random.default_rng(2)
    v, cents = rng.integers(-60, 60, (500, 8)), rng.integers(-60, 60, (9, 8))
    own, gap = C.scan(v, cents)
    d = np.sqrt(((v[:, None] - cents) ** 2).sum(axis=2))
    assert (own == d.argmin(axis=1)).all()
    two = np.sort(d, axis=1)[:, :2]
    assert (gap <= two[:, 1] - two[:, 0]).all() and (gap >= two[:, 1] - two[:, 0] - 1e-6).all()
    moved = cents + rng.integers(-3, 4, cents.shape)
    e = np.sqrt(((v[:, None] - moved) ** 2).sum(axis=2))
    left = (e + np.where(np.arange(9) == own[:, None], np.inf, 0)).min(axis=1) - e[np.arange(500), own]
    assert (left >= gap - C.drifts(cents, moved)[own] - 1e-9).all()


def test_few_and_none(spark):
    rows = [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-1.0, 2.0])]
    assert got(frame(spark, rows), k=16, rounds=3, dim=2, scale=64) == brute(rows, 16, 3, 2, 64)
    assert got(frame(spark, [(1, [0.5])]), k=4, dim=2) == []
    assert got(frame(spark, []), k=4, dim=2) == []
