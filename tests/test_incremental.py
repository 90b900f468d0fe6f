"""Drift scenario and streaming replays."""

import pytest
from pyspark.sql import functions as F

from conftest import MEDIUM, SMALL
from grove.operators.evaluate import accuracy
from grove.operators.forest import IncrementalForest
from grove.operators.growth import ForestParams
from grove.plans import fixtures as FX


def test_replacement_beats_keep_after_drift(spark):
    """The hyperplane label is inverted from a date on: a forest that
    replaces trees adapts, one that only keeps them cannot."""
    d = FX.drift(spark, MEDIUM).drop("batch")
    before = d.where(F.col("l_shipdate") < F.lit(FX.DRIFT_DATE).cast("timestamp_ntz"))
    after = d.where(F.col("l_shipdate") >= F.lit(FX.DRIFT_DATE).cast("timestamp_ntz"))
    from grove.operators.sampling import split_batches
    halves = split_batches(after, 2, holdout=False)
    a1 = halves.where(F.col("batch") == 0).drop("batch")
    a2 = halves.where(F.col("batch") == 1).drop("batch")
    errs = {}
    for name, (r, p) in {"keep": (0.0, 0.0), "replace": (1.0, 0.0)}.items():
        est = IncrementalForest(FX.hyperplane_spec(), ForestParams(
            num_trees=6, max_depth=4, seed=2, regrow_prop=r, incremental_prop=p))
        m = est.update(est.fit(before), a1)
        errs[name] = 1 - accuracy(m.transform(a2)).first()["accuracy"]
    assert errs["replace"] < errs["keep"] - 0.2, errs


def _nodes(m):
    return m.nodes.drop(columns=["left_categories"]).to_json()


def _stats(spark, m):
    return sorted(map(tuple, m.leaf_stats(spark).select("tree_id", "node_id", "feature", "bin", "s0", "s1").collect()))


@pytest.fixture()
def batches(spark):
    from grove.operators.sampling import split_batches
    h = split_batches(FX.hyperplane(spark, SMALL), 3, holdout=False)
    return [h.where(F.col("batch") == b).drop("batch") for b in range(3)]


def _est(**kw):
    return IncrementalForest(FX.hyperplane_spec(), ForestParams(
        num_trees=3, max_depth=3, seed=4, incremental_prop=1.0, regrow_prop=0.0, **kw))


def test_stream_skips_replays_and_takes_new_sources(spark):
    import glob
    import os
    import re

    from grove.operators.sampling import split_batches
    from grove.session import new_work_path
    from grove.streaming.stream import stream_updates, write_batches
    ev = split_batches(FX.events(spark, SMALL), 4, holdout=False)
    one, two = new_work_path(spark, "t-stream"), new_work_path(spark, "t-stream")
    write_batches(ev, one, "batch", [0, 1])
    write_batches(ev, two, "batch", [2, 3])
    schema = spark.read.parquet(f"{one}/batch=0").schema
    est = IncrementalForest(FX.events_spec(), ForestParams(num_trees=2, max_depth=2, seed=1))
    root, ckpt = new_work_path(spark, "t-stream-model"), new_work_path(spark, "t-stream-ckpt")
    st = stream_updates(spark, f"{one}/*", schema, est, root, checkpoint=ckpt)
    assert st["batches"] == [0, 1] and st["model"].version == 1
    rows = st["model"].rows_seen
    # the driver died after the version, before the stream's own commit
    commits = glob.glob(re.sub("^file:/+", "/", ckpt) + "/commits/*1*", include_hidden=True)
    assert len(commits) == 2  # the entry and its checksum
    for f in commits:
        os.remove(f)
    st = stream_updates(spark, f"{one}/*", schema, est, root, checkpoint=ckpt)
    assert st["batches"] == [] and st["skipped"] == [1]
    assert (st["model"].version, st["model"].rows_seen) == (1, rows)
    # another source numbers its batches from 0 again: all of it is new
    st = stream_updates(spark, f"{two}/*", schema, est, root)
    assert st["batches"] == [0, 1] and st["skipped"] == []
    assert st["model"].version == 3 and st["model"].rows_seen == ev.count()


def test_crash_before_meta_leaves_nothing(spark, batches, monkeypatch):
    """A run that dies between its tables and ``meta``, retried, equals a clean run."""
    from grove.sources import model_store as MS
    clean = _est().update(_est().fit(batches[0]), batches[1])
    m0 = _est().fit(batches[0])
    real = MS.save_version

    def dies(spark, root, version, meta, splits_rows, trees, nodes, mode="error", extra=(), *rest):
        for fn in extra:
            if fn is not None:
                fn()
        raise RuntimeError("executor lost")

    monkeypatch.setattr(MS, "save_version", dies)
    with pytest.raises(RuntimeError):
        _est().update(m0, batches[1])
    monkeypatch.setattr(MS, "save_version", real)
    m1 = _est().update(m0, batches[1])
    assert _nodes(m1) == _nodes(clean) and _stats(spark, m1) == _stats(spark, clean)
    assert _nodes(_est().update(m1, batches[2])) == _nodes(_est().update(clean, batches[2]))


def test_overwrite_equals_a_clean_run(spark, batches):
    from grove.operators.forest import ForestModel
    est = _est()
    m = est.update(est.fit(batches[0]), batches[1])
    again = est.fit(batches[0], m.root, mode="overwrite")
    clean = est.fit(batches[0])
    assert _stats(spark, again) == _stats(spark, clean)
    assert ForestModel.load(spark, m.root).version == 0  # the old version 1 is retired
    a, b = est.update(again, batches[2]), est.update(clean, batches[2])
    assert _nodes(a) == _nodes(b) and ForestModel.load(spark, m.root).version == 1
    with pytest.raises(FileExistsError):
        est.fit(batches[0], m.root)


def test_update_merges_old_and_new_counts(spark, batches):
    """A reopened leaf's count is the old one plus the new batch's."""
    est = _est()
    m0 = est.fit(batches[0])
    m1 = est.update(m0, batches[1])
    for t in range(3):
        root = m1.nodes[(m1.nodes.tree_id == t) & (m1.nodes.node_id == 1)].iloc[0]
        assert not root.is_leaf
    total = sum(r[4] + r[5] for r in _stats(spark, m1) if r[2] == 0)
    old = sum(r[4] + r[5] for r in _stats(spark, m0) if r[2] == 0)
    assert total > old


def test_update_without_statistics_raises(spark, batches):
    m = _est(store_leaf_stats=False).fit(batches[0])
    with pytest.raises(ValueError, match="without leaf statistics"):
        _est().update(m, batches[1])


def test_incompatible_updates_raise(spark, batches):
    m = _est().fit(batches[0])
    for other in (_est(impurity="entropy"), _est(max_bins=8)):
        for run in (lambda: other.update(m, batches[1]), lambda: other.add_trees(m, batches[1], 1)):
            with pytest.raises(ValueError, match="differ"):
                run()


def test_missing_values_policy(spark):
    h = FX.hyperplane(spark, SMALL).withColumn(
        "l_tax", F.when(F.col("rk") % 5 == 0, F.lit(None)).otherwise(F.col("l_tax")))
    with pytest.raises(Exception):
        IncrementalForest(FX.hyperplane_spec(), ForestParams(num_trees=1, max_depth=2)).fit(h)
    m = IncrementalForest(FX.hyperplane_spec(), ForestParams(
        num_trees=1, max_depth=2, on_missing="keep")).fit(h)
    assert m.transform(h).count() == h.count()


def test_strategies(spark, batches):
    for name in ("default", "batched", "replacement", "combined"):
        est = IncrementalForest.for_strategy(FX.hyperplane_spec(), name, num_trees=2, max_depth=2, seed=1)
        m = est.advance(est.advance(None, batches[0]), batches[1], [batches[0]])
        n = batches[0].count() + batches[1].count()
        assert m.rows_seen == n and m.version == (0 if name == "default" else 1)
        if name == "default":
            whole = est.fit(batches[0].unionByName(batches[1]))
            assert _nodes(m) == _nodes(whole)


def test_stream_metrics_belong_to_versions(spark, monkeypatch):
    """Test-then-train over batches of several files; a crash after the tables and a
    replay leave one metrics row for each version."""
    from grove.operators.sampling import split_batches
    from grove.session import new_work_path
    from grove.sources import model_store as MS
    from grove.streaming.stream import stream_updates, write_batches
    ev = split_batches(FX.events(spark, SMALL), 3, holdout=False)
    src = new_work_path(spark, "t-metrics")
    write_batches(ev, src, "batch", [0, 1, 2], files=3)
    schema = spark.read.parquet(f"{src}/batch=0").schema
    est = IncrementalForest(FX.events_spec(), ForestParams(num_trees=2, max_depth=2, seed=1))
    root, ckpt = new_work_path(spark, "t-metrics-model"), new_work_path(spark, "t-metrics-ckpt")
    real, calls = MS.save_version, []

    def dies(spark, root, version, meta, splits_rows, trees, nodes, mode="error", extra=(), *rest):
        calls.append(version)
        if calls.count(1) == 1 and version == 1:
            for fn in extra:
                if fn is not None:
                    fn()
            raise RuntimeError("executor lost")
        return real(spark, root, version, meta, splits_rows, trees, nodes, mode, extra, *rest)

    monkeypatch.setattr(MS, "save_version", dies)
    with pytest.raises(Exception):
        stream_updates(spark, f"{src}/*", schema, est, root, checkpoint=ckpt, files_per_batch=3, test_first=True)
    st = stream_updates(spark, f"{src}/*", schema, est, root, checkpoint=ckpt, files_per_batch=3, test_first=True)
    assert st["model"].version == 2 and st["model"].rows_seen == ev.count()
    got = [r.asDict() for r in MS.metrics(spark, root).orderBy("version").collect()]
    assert [(r["version"], r["batch"]) for r in got] == [(0, 0), (1, 1), (2, 2)] and got[0]["error"] is None
    m = est.fit(ev.where("batch = 0"))
    for b in (1, 2):
        part = ev.where(F.col("batch") == b)
        assert got[b]["error"] == pytest.approx(1 - accuracy(m.transform(part)).first()["accuracy"])
        m = est.update(m, part)
        assert got[b]["rows_seen"] == m.rows_seen
    assert MS.metrics(spark, m.root).count() == 0  # versions made without a test have none


def test_too_few_rows_for_the_files(spark):
    from grove.session import new_work_path
    from grove.streaming.stream import write_batches
    with pytest.raises(ValueError, match="too few rows"):
        write_batches(spark.createDataFrame([(1, 0)], "x int, batch int"), new_work_path(spark, "t-few"), "batch", [0], files=3)
