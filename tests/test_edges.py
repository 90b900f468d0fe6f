"""Edge rows: constant feature, one class only, zero weights, invalid
labels, empty batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from grove.operators.features import FeatureSpec
from grove.operators.forest import IncrementalForest
from grove.operators.growth import ForestParams
from grove.plans import fixtures as FX

P = dict(num_trees=2, max_depth=2, seed=4)


def test_constant_feature_is_never_split(spark):
    h = FX.hyperplane(spark, SMALL).withColumn("flat", F.lit(7.0))
    spec = FeatureSpec(FX.HYPER_FEATURES + ["flat"], [0] * 5, "label", 2)
    m = IncrementalForest(spec, ForestParams(**P)).fit(h)
    assert 4 not in set(m.nodes[~m.nodes.is_leaf].feature)
    assert m.transform(h).count() == h.count()


def test_one_class_only_gives_a_single_leaf(spark):
    h = FX.hyperplane(spark, SMALL).withColumn("label", F.lit(0.0))
    m = IncrementalForest(FX.hyperplane_spec(), ForestParams(**P)).fit(h)
    assert m.nodes.is_leaf.all() and (m.nodes.node_id == 1).all()
    assert m.transform(h).where("prediction != 0").count() == 0


def test_zero_weights_count_nothing(spark):
    h = FX.hyperplane(spark, SMALL).withColumn(
        "w", F.when(F.col("l_quantity") > 25, 0.0).otherwise(1.0))
    spec = FeatureSpec(list(FX.HYPER_FEATURES), [0] * 4, "label", 2, weight="w")
    m = IncrementalForest(spec, ForestParams(num_trees=1, max_depth=1, seed=4)).fit(h)
    root = m.nodes[m.nodes.node_id == 1].iloc[0]
    assert root["count"] == h.where("l_quantity <= 25").count()


@pytest.mark.parametrize("bad", [-1.0, 0.5])
def test_invalid_labels_raise(spark, bad):
    h = FX.hyperplane(spark, SMALL).withColumn(
        "label", F.when(F.col("l_quantity") == 1, F.lit(bad)).otherwise(F.col("label")))
    with pytest.raises(ValueError):
        IncrementalForest(FX.hyperplane_spec(), ForestParams(**P)).fit(h)


def test_empty_batch_update_keeps_splits_and_counts(spark):
    """No new rows: existing splits stay; reopened leaves keep their stored
    counts (they may split further on their stored histograms)."""
    h = FX.hyperplane(spark, SMALL)
    est = IncrementalForest(FX.hyperplane_spec(), ForestParams(**P))
    m0 = est.fit(h)
    m1 = est.update(m0, h.where(F.lit(False)))
    assert m1.version == 1 and m1.rows_seen == m0.rows_seen
    new = m1.nodes.set_index(["tree_id", "node_id"])
    for r in m0.nodes.itertuples():
        n = new.loc[(r.tree_id, r.node_id)]
        if not r.is_leaf:
            assert (n.feature, n.split_idx) == (r.feature, r.split_idx)
        else:
            assert np.isclose(n["count"], r.count)


def test_update_merges_stored_leaf_histograms(spark):
    """A reopened leaf's statistics are its stored ones plus the new
    batch's (bag-weighted) rows that reach it.  Ten trees, so that decay
    leaves weight 0.9 and the trees grow instead of being replaced."""
    from grove.operators.sampling import bag_weights, split_batches
    from grove.operators.score import leaf_ids
    h = split_batches(FX.hyperplane(spark, SMALL), 2, holdout=False)
    a, b = h.where("batch = 0"), h.where("batch = 1")
    est = IncrementalForest(FX.hyperplane_spec(), ForestParams(
        num_trees=10, max_depth=2, seed=4, feature_subset="all"))
    m0 = est.fit(a)
    m1 = est.update(m0, b)
    assert (m1.trees.origin == "grown").all()
    routed = leaf_ids(m0, b, keep=["rk"]).select("rk", F.col("node_ids")[0].alias("node_id"))
    w = bag_weights(b, 10, seed=4).where("tree_id = 0")
    per_leaf = routed.join(w, "rk").groupBy("node_id").agg(F.sum("weight").alias("w")) \
        .toPandas().set_index("node_id")["w"]
    new = m1.nodes.set_index(["tree_id", "node_id"])
    leaves = m0.nodes[(m0.nodes.tree_id == 0) & m0.nodes.is_leaf]
    assert len(leaves) > 1
    for r in leaves.itertuples():
        assert np.isclose(new.loc[(0, r.node_id)]["count"], r.count + per_leaf.get(r.node_id, 0))
