"""Statistics on awkward data: offsets, nulls, one class, root-only trees."""

import math

import pytest
from pyspark.sql import functions as F

from grove.functions.hashing import poisson_cdf
from grove.operators import evaluate as E
from grove.operators import stats as L
from grove.operators.inspect import tree_rules


def frame(spark, rows):
    return spark.createDataFrame(rows, "x double, z double, label double, w double")


def test_variance_with_a_large_offset(spark):
    rows = [(1e9 + i % 3, float(i), 0.0, 1.0) for i in range(300)]
    r = {x["feature"]: x for x in L.column_summary(frame(spark, rows), ["x", "z"]).collect()}
    assert r["x"]["variance"] == pytest.approx(2 / 3 * 300 / 299, rel=1e-9)
    assert r["x"]["mean"] == pytest.approx(1e9 + 1)
    assert r["x"]["norm_l2"] == pytest.approx(math.sqrt(sum((1e9 + i % 3) ** 2 for i in range(300))))


def test_merge_of_parts_with_different_offsets(spark):
    a = [(1e9 + i % 3, 1.0, 0.0, 2.0) for i in range(100)]
    b = [(1e9 + 5 + i % 4, 1.0, 0.0, 1.0) for i in range(50)] + [(None, 2.0, 0.0, 1.0)]
    merged = L.summary_from_moments(L.merge_moments(L.moments(frame(spark, a), ["x"], "w"), L.moments(frame(spark, b), ["x"], "w")))
    whole = L.column_summary(frame(spark, a + b), ["x"], "w")
    m, h = merged.first(), whole.first()
    for c in ("count", "mean", "variance", "min", "max", "norm_l1", "norm_l2"):
        assert m[c] == pytest.approx(h[c], rel=1e-9)


def test_joint_summary_counts_rows_with_a_null_feature(spark):
    rows = [(None, 1.0, 0.0, 1.0), (2.0, 1.0, 0.0, 3.0), (3.0, None, 1.0, 1.0)]
    _, labels = L.joint_summary(frame(spark, rows), ["x", "z"], weight="w")
    assert {r["label"]: (r["n"], r["weight"]) for r in labels.collect()} == {0.0: (2, 4.0), 1.0: (1, 1.0)}


@pytest.mark.parametrize("label", [0, 1])
def test_curves_on_one_class(spark, label):
    df = spark.createDataFrame([(i / 10, label) for i in range(10)], "score double, label int")
    bins = E.score_bins(df, num_bins=5)
    roc, pr = E.roc_curve(bins).collect(), E.pr_curve(bins).collect()
    assert len(roc) > 2 and len(pr) > 1
    assert E.auc(E.roc_curve(bins)).first()[0] is not None
    for r in E.metrics_by_threshold(bins).collect():
        assert (r["precision"], r["recall"] > 0) == (float(label), bool(label))


def test_rules_of_a_root_only_tree(spark):
    nodes = spark.createDataFrame([(0, 1, True, -1, -1, 0.0, [], 1.0), (1, 1, False, 0, 2, 0.5, [], 0.0),
                                   (1, 2, True, -1, -1, 0.0, [], 0.0), (1, 3, True, -1, -1, 0.0, [], 1.0)],
                                  "tree_id int, node_id long, is_leaf boolean, feature int, split_idx int, threshold double, "
                                  "left_categories array<int>, prediction double")
    got = {(r.tree_id, r.node_id): (r.rule, r.prediction) for r in tree_rules(nodes, style="bins").collect()}
    assert got == {(0, 1): ("", 1.0), (1, 2): ("f0 <= 2", 0.0), (1, 3): ("f0 > 2", 1.0)}


def test_ordered_categories_follow_the_chosen_impurity(spark):
    """Three classes: categories are ordered by entropy if entropy is chosen."""
    from grove.functions import impurity as I
    from grove.operators.growth import split_candidates
    from grove.operators.splits import Splits
    counts = {0: (9., 1., 0.), 1: (4., 3., 3.), 2: (5., 5., 0.), 3: (6., 2., 2.), 4: (1., 0., 0.), 5: (7., 3., 0.), 6: (3., 3., 1.)}
    hist = spark.createDataFrame([(0, 1, 0, b, *c) for b, c in counts.items()],
                                 "tree_id int, node_id long, feature int, bin int, s0 double, s1 double, s2 double")
    import numpy as np
    splits = Splits([np.zeros(0)], [7], [False])
    for kind in ("gini", "entropy"):
        cen = {r["bin"]: r["c"] for r in hist.select("bin", I.impurity(kind, [F.col(f"s{k}") for k in range(3)]).alias("c")).collect()}
        want = sorted(cen, key=lambda b: (cen[b], b))
        rows = split_candidates(hist, [7], splits, 3, kind=kind).orderBy("cand").collect()
        assert [r["left_categories"] for r in rows] == [want[:k + 1] for k in range(7)]


def test_poisson_table_covers_large_rates():
    for rate in (0.5, 1.0, 150.0, 400.0):
        cdf = poisson_cdf(rate)
        assert cdf[-1] > 1 - 1e-9 and len(cdf) > rate


def test_work_folder_is_named_on_a_cluster():
    from grove.session import work_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *a):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_dir(Session())


def test_string_index_holds_many_labels(spark):
    from grove.operators.features import fit_string_index, string_index
    df = spark.range(0, 30_000).selectExpr("cast(id % 12000 as string) AS c").unionAll(
        spark.createDataFrame([("top",)] * 9 + [(None,)], "c string"))
    index = fit_string_index(df, "c")
    assert index.labels[0] == "top" and len(index.labels) == 12001
    out, _ = string_index(df, "c", "i", index=index, handle_invalid="keep")
    got = {r.c: r.i for r in out.distinct().collect()}
    counts = {r["c"]: r["count"] for r in df.where("c is not null").groupBy("c").count().collect()}
    want = {c: float(k) for k, c in enumerate(sorted(counts, key=lambda c: (-counts[c], c)))}
    assert got == want | {None: 12001.0}
    with pytest.raises(Exception, match="unseen label"):
        string_index(df, "c", "i", index=index)[0].collect()


def test_moments_read_the_table_once(spark, tmp_path):
    rows = [(1e9 + i % 5, float(i % 3), float(i % 2), 1.0 + i % 2) for i in range(200)] + [(None, math.nan, 1.0, 1.0)]
    frame(spark, rows).repartition(6).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    whole, by_label = L.moments(df, ["x", "z"], "w"), L.moments(df, ["x", "z"], "w", ["label"])
    for m in (whole, by_label, L.merge_moments(by_label.drop("label"))):
        plan = m._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1
    got = {r.feature: r for r in L.summary_from_moments(L.merge_moments(by_label.drop("label"))).collect()}
    want = {r.feature: r for r in L.summary_from_moments(whole).collect()}
    for c in ("count", "mean", "variance", "min", "max", "num_nonzeros", "norm_l1", "norm_l2"):
        assert got["x"][c] == pytest.approx(want["x"][c], rel=1e-9)
    xs, ws = [r[0] for r in rows[:-1]], [r[3] for r in rows[:-1]]
    mean = sum(x * w for x, w in zip(xs, ws)) / sum(ws)
    assert want["x"]["mean"] == pytest.approx(mean)
    assert want["x"]["variance"] == pytest.approx(
        sum(w * (x - mean) ** 2 for x, w in zip(xs, ws)) / (sum(ws) - sum(w * w for w in ws) / sum(ws)), rel=1e-9)
    assert want["z"]["min"] == 0 and math.isnan(want["z"]["max"]) and math.isnan(want["z"]["mean"])


def test_moments_of_nothing_and_of_many_groups(spark, monkeypatch):
    empty = {r.feature: r for r in L.moments(frame(spark, []), ["x", "z"]).collect()}
    assert {f: (r.n, r.rows, r.w, r.vmin) for f, r in empty.items()} == {"x": (0, 0, None, None), "z": (0, 0, None, None)}
    nulls = L.moments(frame(spark, [(None, 1.0, None, 1.0)] * 3), ["x"], group_by=["label"]).first()
    assert (nulls.n, nulls.rows, nulls.label, nulls.w, nulls.nnz) == (0, 3, None, None, 0.0)
    monkeypatch.setattr(L, "MAX_HELD_GROUPS", 5)
    rows = [(float(i), 1.0, float(i % 40), 1.0) for i in range(400)]
    got = {r.label: (r.n, r.vmin, r.vmax) for r in L.moments(frame(spark, rows), ["x"], group_by=["label"]).collect()}
    assert got == {float(k): (10, float(k), float(k + 360)) for k in range(40)}
