import pytest
from pyspark.sql import functions as F

from grove.operators import evaluate as E
from grove.operators import grid
from grove.operators.forest import IncrementalForest
from grove.operators.growth import ForestParams
from grove.operators.sampling import split_batches
from grove.plans import catalog
from grove.plans import fixtures as FX
from grove.sources.batches import BatchStore


def test_grid_and_prequential_queries_cover_all_policies_and_batches(spark, monkeypatch):
    """What the registered queries hand to the runs."""
    runs = []

    def record(fit, update, score, batches, batch_col="batch", holdout=None, regrow=0.0, incremental=1.0):
        runs.append((regrow, incremental, batches, holdout))
        return spark.createDataFrame([], E.METRICS_SCHEMA)

    monkeypatch.setattr(E, "prequential", record)
    sf = "/root/testdata/sf0.001"
    seen = {}
    monkeypatch.setattr(grid, "grid_errors", lambda est, policies, batches, holdout=None: seen.update(
        policies=policies, batches=batches, holdout=holdout))
    catalog.policy_grid(spark, sf)
    assert sorted(seen["policies"]) == sorted((r / 10, p / 10) for r in range(11) for p in range(11 - r))
    assert {r[0] for r in seen["batches"].select("batch").distinct().collect()} == set(range(11)) and seen["holdout"] == 10
    catalog.prequential_errors(spark, sf)
    catalog.prequential_next_batch(spark, sf)
    for (_, _, batches, holdout), last in zip(runs, (15, 14)):
        assert {r[0] for r in batches.select("batch").distinct().collect()} == set(range(last + 1))
        assert holdout == (15 if last == 15 else None)


def _rows(df):
    return sorted(map(tuple, df.select("rk", "label", "value", "hour", "user_key").collect()))


def test_store_reads_one_batch_alone(spark):
    ev = split_batches(FX.events(spark, "/root/testdata/sf0.001"), 5)
    store = BatchStore.write(ev)
    assert store.ids() == [0, 1, 2, 3, 4, 5]
    for b in store.ids():
        part = store.read(b)
        assert _rows(part) == _rows(ev.where(F.col("batch") == b))
        assert all(f"/batch={b}/" in f for f in part.inputFiles())
        assert part.select("batch").distinct().collect() == [(b,)]
    assert _rows(store.upto(2)) == _rows(ev.where("batch <= 2"))
    assert not any("batch=3" in f or "batch=4" in f for f in store.upto(2).inputFiles())
    assert store.read(9).count() == 0 and store.read(9).columns == store.read(1).columns
    # a later batch joins the same store
    BatchStore.write(ev.where("batch = 1").withColumn("batch", F.lit(7)), store.path)
    assert store.ids()[-1] == 7 and _rows(store.read(7)) == _rows(store.read(1))


def test_store_edges(spark):
    ev = split_batches(FX.events(spark, "/root/testdata/sf0.001"), 2).limit(0)
    assert BatchStore.write(ev).ids() == []
    with pytest.raises(Exception, match="no batch number"):
        BatchStore.write(spark.createDataFrame([(1, None)], "x int, batch int"))


SETTINGS = [(dict(num_trees=3, max_depth=3, seed=0), 4), (dict(num_trees=4, max_depth=2, seed=5, erf=True, feature_subset=2), 2),
            (dict(num_trees=2, max_depth=29, min_instances_per_node=120.0), 1)]


@pytest.mark.parametrize("settings,alone", SETTINGS)
def test_grid_equals_separate_runs(spark, settings, alone):
    """Metrics of every step, and the last forests node by node."""
    store = BatchStore.write(split_batches(FX.events(spark, "/root/testdata/sf0.001"), 4))
    policies = [(0.3, 0.4), ("ratio", 0.5), (0.0, 1.0), (0.0, 0.0), (1.0, 0.0), (0.3, 0.4)]
    g = grid.PolicyGrid(IncrementalForest(FX.events_spec(), ForestParams(**settings)), policies)
    for b in range(4):
        g.fit(store.read(b)) if b == 0 else g.update(store.read(b))
    right = {r["policy"]: r for r in g.right(store.read(4)).collect()}
    assert sum(len({u for u, _ in m}) for m in g.members) > len(g.units)  # policies share trees
    for i, (r, p) in enumerate(policies[:alone]):
        est = IncrementalForest(FX.events_spec(), ForestParams(**settings, regrow_prop=r, incremental_prop=p))
        m = est.fit(store.read(0))
        for b in (1, 2, 3):
            m = est.update(m, store.read(b))
        mine = g.model(i)
        assert mine.nodes.to_json() == m.nodes.to_json()
        cols = ["tree_id", "weight", "max_depth", "born_version"]
        assert mine.trees[cols].values.tolist() == m.trees[cols].values.tolist() and mine.rows_seen == m.rows_seen
        s = m.transform(store.read(4)).select(F.sum((F.col("prediction") == F.col("label")).cast("long")), F.count("label")).first()
        assert (right[i]["ok"], right[i]["n"]) == tuple(s)
    assert tuple(right[5])[1:] == tuple(right[0])[1:]


def test_grid_errors_equal_prequential(spark):
    store = BatchStore.write(split_batches(FX.events(spark, "/root/testdata/sf0.001"), 3))
    est = IncrementalForest(FX.events_spec(), ForestParams(num_trees=2, max_depth=2, regrow_prop=0.5, incremental_prop=0.2))
    for holdout in (3, None):
        a = grid.grid_errors(est, [(0.5, 0.2), (0.0, 1.0)], store, holdout=holdout).drop("seconds").collect()
        b = E.prequential(est.fit, est.update, lambda m, d: m.transform(d), store, holdout=holdout, regrow=0.5,
                          incremental=0.2).drop("seconds").collect()
        assert [r for r in a if r["regrow"] == 0.5] == b and len(a) == 2 * len(b) == 6


def test_grid_refuses(spark):
    with pytest.raises(ValueError):
        grid.PolicyGrid(IncrementalForest(FX.events_spec(), ForestParams(store_leaf_stats=False)), [(0.0, 1.0)])
