import numpy as np
import pytest

from grove.operators import splits as Q


def walk(vals, num_splits):
    """The sequential equal-frequency walk, written plainly."""
    vs, cnt = np.unique(vals, return_counts=True)
    if len(vs) <= num_splits:
        return list(vs)
    stride = len(vals) / (num_splits + 1)
    out, cur, tgt = [], cnt[0], stride
    for i in range(1, len(vs)):
        prev = cur
        cur += cnt[i]
        if abs(prev - tgt) < abs(cur - tgt):
            out.append(vs[i - 1])
            tgt += stride
    return out


@pytest.mark.parametrize("seed,n,distinct,splits", [
    (0, 3000, 50, 7), (1, 5000, 4000, 31), (2, 800, 900, 15), (3, 2000, 12, 31),
    (4, 4000, 300, 3)])
def test_closed_form_equals_walk(spark, seed, n, distinct, splits):
    rng = np.random.default_rng(seed)
    vals = rng.integers(0, distinct, n).astype(float) ** 1.5  # skewed, many ties
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    for range_rows in (None, 70):  # one range, and a feature over many
        tab = Q.continuous_thresholds(Q.value_counts(df, ["x"]), splits, range_rows).collect()
        got = [r.threshold for r in sorted(tab, key=lambda r: r.split_idx)]
        assert np.allclose(got, walk(vals, splits)), (seed, range_rows)
        assert [r.split_idx for r in sorted(tab, key=lambda r: r.split_idx)] == list(range(len(got)))


def test_unordered_subsets(spark):
    ar = spark.createDataFrame([(0, 3)], "feature int, arity int")
    rows = sorted(Q.unordered_subsets(ar).collect(), key=lambda r: r.split_idx)
    assert [r.categories for r in rows] == ["0", "1", "0,1"]


def test_bins_np_left_closed():
    th = np.array([1.0, 2.0, 3.0])
    assert list(Q.bins_np(np.array([0.5, 1.0, 1.5, 3.0, 9.0, np.nan]), th)) == [0, 0, 1, 2, 3, 3]


@pytest.mark.parametrize("seed,n,distinct,splits", [
    (0, 3000, 50, 7), (1, 5000, 4000, 31), (3, 2000, 12, 31), (5, 100, 100, 99)])
def test_numpy_closed_form_equals_walk(seed, n, distinct, splits):
    rng = np.random.default_rng(seed)
    vals = rng.integers(0, distinct, n).astype(float) ** 1.5
    v, c = np.unique(vals, return_counts=True)
    assert np.allclose(Q.thresholds_np(v, c, splits), walk(vals, splits))


@pytest.mark.parametrize("range_rows", [None, 13, 100])
@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_equal_windows(spark, range_rows, descending):
    """Groups over many ranges, many groups in one, one group without a key, none at all."""
    from grove.operators.prefix import running_sums
    rng = np.random.default_rng(7)
    rows = {(int(g), float(v)): int(rng.integers(-5, 9)) for g, v in zip(rng.integers(0, 4, 900), rng.integers(-400, 400, 900) / 2)}
    rows |= {(9, 1.0): 3, (10, float("-inf")): 2, (10, float("inf")): 1}
    df = spark.createDataFrame([(g, v, n, "x") for (g, v), n in rows.items()], "g int, v double, n bigint, other string").repartition(5)
    want, count, cum = {}, {}, {}
    for g, v in sorted(rows, key=lambda k: (k[0], -k[1] if descending else k[1])):
        count[g], cum[g] = count.get(g, 0) + 1, cum.get(g, 0) + rows[g, v]
        want[g, v] = (count[g], cum[g])
    got = running_sums(df, ["g"], "v", ["n"], descending, totals=True, range_rows=range_rows).collect()
    assert {(r.g, r.v): (r.rank, r.cum_n) for r in got} == want and len(got) == len(rows)
    assert all((r.tot_rows, r.tot_n, r.other) == (count[r.g], cum[r.g], "x") for r in got)
    one = df.where("g = 1").drop("g")
    got = running_sums(one, [], "v", [], descending, range_rows=range_rows).collect()
    assert [r.v for r in sorted(got, key=lambda r: r["rank"])] == sorted((r.v for r in got), reverse=descending)
    assert sorted(r["rank"] for r in got) == list(range(1, len(got) + 1))
    assert running_sums(df.limit(0), ["g"], "v", ["n"], descending, range_rows=range_rows).count() == 0
