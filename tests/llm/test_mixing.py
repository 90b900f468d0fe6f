import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from grove.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size string, target string, rate string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "e", "e", "e") for r in rows], SCHEMA).repartition(parts)


def corpus(rng, n=900):
    """A source with a third of all documents, many of one size, and a few small ones."""
    names = ["a", "b", "é", "z", "\U0001F600", None, "", "tiny", "nothing"]
    rows = []
    for i in range(n):
        s = "hot" if i % 3 == 0 else names[int(rng.integers(0, 7))]
        rows.append((i, " ".join(["w"] * int(40 if i % 6 == 0 else rng.geometric(0.01))), s))
    rows += [(5000, "three small words", "tiny"), (5001, None, "nothing"), (5002, " \n\t", "nothing"), (5003, None, None)]
    rows += [(6000, "same " * 7, "a")] * 5 + [(None, "null id here", "a"), (None, "null id here", "b"), (7000, "long " * 20_000, "b"),
                                             (7000, "other text", "b")]
    return rows


def plain_targets(rows, weights=(5, 2, 1), most=3):
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").encode().split())
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, target = sum(size.values()), {}
    while True:
        rest = [s for s in order if s not in target]
        if not rest:
            return size, target
        level = left / sum(weight[s] for s in rest)
        full = [s for s in rest if weight[s] * level >= most * size[s]]
        for s in full:
            target[s] = float(most * size[s])
            left -= most * size[s]
        if not full:
            return size, target | {s: weight[s] * level for s in rest}


def tilted(sizes, target, most):
    """The optimum's rates by bisection."""
    mean = sum(sizes) / sum(s > 0 for s in sizes)
    rate = lambda lam, s: 1.0 if s == 0 else math.exp(min(lam * s / mean, math.log(most)))
    lo, hi = -1e6, 1e6
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(rate(mid, s) * s for s in sizes) < target else (lo, mid)
    return [rate(lo, s) for s in sizes]


@pytest.fixture(scope="module")
def rows():
    return corpus(np.random.default_rng(4))


@pytest.fixture(scope="module")
def mixed(spark, rows):
    return M.mix(frame(spark, rows)).withColumn("who", F.when(~F.col("none"), F.col("source"))).collect()


def test_sizes_and_targets(rows, mixed):
    size, target = plain_targets(rows)
    assert len(mixed) == len(rows)
    assert sorted((r.doc_id or -1, r.size) for r in mixed) == sorted((d or -1, len((t or "").encode().split())) for d, t, _ in rows)
    for r in mixed:
        assert r.source_size == size[r.who] and r.target == pytest.approx(target[r.who], rel=1e-12)
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    assert any(target[s] == 3 * size[s] > 0 for s in size) and any(target[s] < size[s] for s in size)


def test_rates_are_the_optimum(rows, mixed):
    _, target = plain_targets(rows)
    for s in target:
        mine = [r for r in mixed if r.who == s]
        if not sum(r.size for r in mine):
            continue
        if target[s] == 3 * sum(r.size for r in mine):
            assert all(r.rate == 3.0 or r.size == 0 for r in mine)
            continue
        for r, want in zip(mine, tilted([r.size for r in mine], target[s], 3)):
            assert r.rate == pytest.approx(want, rel=1e-6)


def test_taken_words_meet_the_targets(rows, mixed):
    _, target = plain_targets(rows)
    for s in target:
        mine = sorted((r for r in mixed if r.who == s and r.size), key=lambda r: r.size)
        taken = sum(r.copies * r.size for r in mine)
        assert abs(taken - target[s]) <= max(0.001 * target[s], *(r.size for r in mine[:1]), 1) if len(mine) > 1 else True
        assert all(0 <= r.copies <= 3 for r in mine)
        of_size = {}
        for r in mine:
            of_size.setdefault(r.size, set()).add(r.copies)
        assert all(max(c) - min(c) <= 1 for c in of_size.values())  # equal sizes differ by one copy at most
    assert all(r.copies == 1 for r in mixed if r.size == 0)


def test_partitions_do_not_show(spark, rows, mixed):
    again = M.mix(frame(spark, rows[::-1], 7)).collect()
    key = lambda r: (str(r.doc_id), r.none, r.source, r.size, r.rate, r.copies)
    assert sorted(map(key, again)) == sorted(map(key, mixed))


def test_copies_of_sizes():
    assert M.copies_of_sizes([10, 4, 0], [1, 3, 2], [0.6, 1.1, 1.0], 3) == [1, 2, 2]
    rng = np.random.default_rng(0)
    for _ in range(200):
        size = sorted({int(x) for x in rng.integers(1, 50, 12)})
        n, rate = rng.integers(1, 30, len(size)).tolist(), (rng.random(len(size)) * 3).tolist()
        got = M.copies_of_sizes(size, n, rate, 3)
        assert all(0 <= g <= 3 * m for g, m in zip(got, n))


def test_mixture_repeats_rows(spark, rows):
    docs = frame(spark, rows)
    plan = M.mix(docs).cache()
    out = M.mixture(docs, plan)
    want = plan.agg(F.sum("copies")).first()[0]
    assert out.count() == want
    words = out.select(F.sum(F.size(F.filter(F.split("text", "[ \n\t]+"), lambda x: x != "")))).first()[0]
    assert words == plan.agg(F.sum(F.col("copies") * F.col("size"))).first()[0]
    plan.unpersist()


def test_empty_and_wordless(spark):
    assert M.mix(frame(spark, [])).count() == 0
    r = M.mix(frame(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert sorted((x.doc_id, x.size, x.target, x.copies) for x in r) == [(1, 0, 0.0, 1), (2, 0, 0.0, 1)]
