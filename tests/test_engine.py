"""Invariants and metamorphic checks of the forest engine."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SMALL
from grove.operators.forest import ForestModel, IncrementalForest, assign_fates
from grove.operators.growth import ForestParams
from grove.operators.sampling import split_batches
from grove.plans import fixtures as FX


def _est(**kw):
    p = dict(num_trees=4, max_depth=3, seed=5)
    p.update(kw)
    return IncrementalForest(FX.hyperplane_spec(), ForestParams(**p))


def test_fit_invariants(spark):
    h = FX.hyperplane(spark, SMALL)
    m = _est().fit(h)
    n = m.nodes
    roots = n[n.node_id == 1]
    # root weight = sum of bag weights, children partition their parent
    assert (roots["count"] > 0).all()
    for r in n[~n.is_leaf].itertuples():
        kids = n[(n.tree_id == r.tree_id) & n.node_id.isin([2 * r.node_id, 2 * r.node_id + 1])]
        assert np.isclose(kids["count"].sum(), r.count)
        assert r.gain > 0
    assert (n.node_id.map(lambda i: int(i).bit_length() - 1) <= 3).all()
    s = m.transform(h).select("probability").toPandas()
    assert np.allclose([sum(p) for p in s.probability], 1.0)


def test_partitioning_does_not_change_the_forest(spark):
    h = FX.hyperplane(spark, SMALL)
    a = _est().fit(h).nodes
    b = _est().fit(h.repartition(7)).nodes
    cols = ["tree_id", "node_id", "feature", "split_idx"]
    assert np.array_equal(a[cols].to_numpy(np.int64), b[cols].to_numpy(np.int64))


def test_update_is_versioned_and_keeps_old_version(spark):
    h = split_batches(FX.hyperplane(spark, SMALL), 2, holdout=False)
    est = _est(incremental_prop=0.5, regrow_prop=0.3)
    m0 = est.fit(h.where(F.col("batch") == 0))
    m1 = est.update(m0, h.where(F.col("batch") == 1))
    assert m1.version == 1 and m1.rows_seen > m0.rows_seen
    again = ForestModel.load(spark, m0.root, 0)
    cols = ["tree_id", "node_id", "feature", "split_idx"]
    assert np.array_equal(again.nodes[cols].to_numpy(np.int64), m0.nodes[cols].to_numpy(np.int64))
    grown = m1.trees[m1.trees.origin == "grown"]
    assert (grown.max_depth == 4).all() and (grown.weight == 1.0).all()
    kept = m1.trees[m1.trees.origin == "kept"]
    assert (kept.weight < 1.0).all()


def test_fate_shares():
    import pandas as pd
    t = pd.DataFrame(dict(tree_id=range(4000), weight=0.9, max_depth=5))
    f = assign_fates(t, 1, 0.2, 0.5, 0)
    share = {k: f.count(k) / len(f) for k in ("grow", "keep", "replace")}
    assert abs(share["grow"] - 0.5) < 0.03
    assert abs(share["replace"] - 0.2) < 0.03


def test_builtin_tree_agrees_on_root(spark):
    """A single unbagged tree and the built-in tree pick the same root split
    feature when the data has a clear best feature."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler
    h = FX.hyperplane(spark, SMALL)
    m = _est(num_trees=1, max_depth=1).fit(h)
    root = m.nodes[m.nodes.node_id == 1].iloc[0]
    v = VectorAssembler(inputCols=FX.HYPER_FEATURES, outputCol="features").transform(h)
    dt = DecisionTreeClassifier(maxDepth=1, maxBins=32).fit(v)
    # depth 1: all importance sits on the root's feature
    assert int(np.argmax(dt.featureImportances.toArray())) == root.feature


def test_expression_and_arrow_scoring_agree(spark):
    from grove.operators.score import transform
    h = FX.hyperplane(spark, SMALL)
    m = _est(num_trees=3, max_depth=3).fit(h)
    a = transform(m, h, keep=["rk"], path="arrow").orderBy("rk").toPandas()
    b = transform(m, h, keep=["rk"], path="expr").orderBy("rk").toPandas()
    assert (a.prediction.values == b.prediction.values).all()
    assert np.allclose(np.stack(a.probability.values), np.stack(b.probability.values))


def test_leaf_statistics_cover_every_leaf(spark):
    """I8: each leaf with data has stored histograms whose per-feature
    totals equal the leaf's weighted count (depth-limit leaves included)."""
    h = FX.hyperplane(spark, SMALL)
    m = _est(num_trees=3, max_depth=3).fit(h)
    ls = m.leaf_stats(spark).groupBy("tree_id", "node_id", "feature") \
        .agg(F.sum(F.col("s0") + F.col("s1")).alias("w")).toPandas()
    tot = ls.groupby(["tree_id", "node_id"]).w.max()
    leaves = m.nodes[m.nodes.is_leaf & (m.nodes["count"] > 0)]
    assert len(leaves) > 0
    for r in leaves.itertuples():
        assert np.isclose(tot.loc[(r.tree_id, r.node_id)], r.count)


def test_memory_chunks_and_plain_mode_give_the_same_forest(spark):
    """Cutting a level into node chunks (max_memory_mb) and skipping leaf
    statistics (the non-incremental forest, T12) change the work, not the
    trees."""
    h = FX.hyperplane(spark, SMALL)
    cols = ["tree_id", "node_id", "feature", "split_idx"]
    base = _est().fit(h).nodes
    # 4 features x 33 bins x 2 classes x 8 bytes ~ 2 KB per node: 0.004 MB -> 2 nodes per pass
    chunked = IncrementalForest(FX.hyperplane_spec(), ForestParams(
        num_trees=4, max_depth=3, seed=5, max_memory_mb=0.004)).fit(h).nodes
    plain = _est(store_leaf_stats=False).fit(h).nodes
    for other in (chunked, plain):
        assert np.array_equal(base[cols].to_numpy(np.int64), other[cols].to_numpy(np.int64))
        assert np.allclose(np.stack(base.stats.values), np.stack(other.stats.values))


def test_histogram_flushing_does_not_change_cells(spark):
    from grove.operators import histogram as Hg
    from grove.operators.growth import GrowState, root_row
    from grove.operators.splits import Splits
    h = FX.hyperplane(spark, SMALL)
    th = [np.array([10.0, 25.0, 40.0]), np.array([0.03, 0.07]), np.array([0.02, 0.05]),
          np.array([20000.0, 50000.0])]
    sp = Splits(th, [len(t) + 1 for t in th], [False] * 4)
    st = GrowState()
    for t in range(3):
        st.nodes[(t, 1)] = root_row(t, 2)
    fo = Hg.FlatForest.build(st.frame(), [0, 1, 2], 1)
    args = (h, FX.HYPER_FEATURES, [0] * 4, sp, 2, fo, {0: 0, 1: 0, 2: 0},
            [(0, 1), (1, 1), (2, 1)], 4, 3, 1.0, 0)
    a = Hg.histogram_pass(*args).orderBy("tree_id", "node_id", "feature", "bin").toPandas()
    b = Hg.histogram_pass(*args, flush_entries=50).orderBy("tree_id", "node_id", "feature",
                                                          "bin").toPandas()
    assert len(a) == len(b) and np.allclose(a[["s0", "s1"]].values, b[["s0", "s1"]].values)


def test_pending_updates_take_no_more_memory_than_the_buffer():
    from grove.operators import histogram as Hg
    assert Hg.flush_entries_for(1280) == Hg.FLUSH_LEAST < 300_000  # five roots: not millions of updates
    assert Hg.flush_entries_for(1_000_000) == 1_000_000
    assert Hg.flush_entries_for(1 << 30) == Hg.FLUSH_ENTRIES


def test_curves_do_not_compute_the_row_key(spark):
    from grove.plans.catalog import _bins
    bins = _bins(spark, SMALL)
    plan = bins._jdf.queryExecution().optimizedPlan().toString() + "".join(
        str(r) for r in [bins._jdf.queryExecution().withCachedData().toString()])
    assert "MapInArrow" in plan and "aggregate(" not in plan  # the hash of key columns folds in ``aggregate``
    last = bins.orderBy(F.desc("bin")).first()
    n = FX.hyperplane(spark, SMALL).agg(F.count(F.lit(1)), F.sum("label")).first()
    assert (last["cum_pos"] + last["cum_neg"], last["cum_pos"]) == tuple(n)


def _leaf_counts_match(spark, df, spec, **kw):
    from grove.operators.score import leaf_ids
    m = IncrementalForest(spec, ForestParams(num_trees=1, max_depth=3, seed=1, **kw)).fit(df)
    assert (~m.nodes.is_leaf).any()
    routed = leaf_ids(m, df, keep=["rk"]).select(F.col("node_ids")[0].alias("node_id")) \
        .groupBy("node_id").count().toPandas().set_index("node_id")["count"]
    leaves = m.nodes[m.nodes.is_leaf & (m.nodes["count"] > 0)]
    for r in leaves.itertuples():
        assert routed.get(r.node_id, 0) == r.count, (r.node_id, routed.get(r.node_id), r.count)
    assert routed.sum() == df.count()
    return m


def test_routing_through_ordered_categories(spark):
    """Growth and scoring route rows identically through category-set
    splits (ordered categories, binary label)."""
    from grove.operators.features import FeatureSpec
    df, arity = FX.categorical(spark, SMALL)
    spec = FeatureSpec(list(FX.CAT_FEATURES), arity, "label", 2)
    m = _leaf_counts_match(spark, df, spec)
    assert any(len(c) > 0 for c in m.nodes.left_categories)


def test_routing_through_unordered_categories(spark):
    """Same with five classes: low-arity features split by subsets."""
    from grove.operators.features import FeatureSpec
    from grove.plans.catalog import _mc_cat
    df, arity, k = _mc_cat(spark, SMALL)
    spec = FeatureSpec(["segment_idx", "status_idx"], arity, "label", k)
    _leaf_counts_match(spark, df, spec)


def test_forest_above_the_broadcast_bound_scores_in_chunks(spark, monkeypatch):
    """Bound of 20 nodes: several chunks of whole trees, equal votes and leaves."""
    from grove.operators import score as S
    h = FX.hyperplane(spark, SMALL)
    m = _est().fit(h)
    want = m.transform(h, keep=["rk"]).toPandas().sort_values("rk")
    ids = S.leaf_ids(m, h, keep=["rk"]).toPandas().sort_values("rk")
    monkeypatch.setattr(S, "MAX_BROADCAST_NODES", 20)
    assert len(S.tree_chunks(m)) > 1 and sum(S.tree_chunks(m), []) == list(m.trees.tree_id)
    got = m.transform(h, keep=["rk"]).toPandas().sort_values("rk")
    for c in ("raw", "probability", "prediction"):
        assert [list(np.atleast_1d(x)) for x in got[c]] == [list(np.atleast_1d(x)) for x in want[c]]
    again = S.leaf_ids(m, h, keep=["rk"]).toPandas().sort_values("rk")
    assert [list(x) for x in again.node_ids] == [list(x) for x in ids.node_ids]
