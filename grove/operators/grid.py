"""Many update policies over one sequence of batches, side by side.

The fate of tree t at version v is drawn from (v, t) alone, so the trees of
different policies often share their whole history: the version they were born in and
the versions that grew them.  Such trees are one *unit*.  A batch then costs one
growth for all units that some policy grows or replaces, with a frontier keyed
(unit, node): one histogram pass a level, whatever the number of policies.  The first
fit has one unit a tree.  A policy is its units and their weights.

Scoring routes each row through every live unit once and adds up the votes of
each policy from its units; only (policy, right, rows) leaves the tasks.

Units are numbered so that unit modulo num_trees is the tree whose draws it uses:
bags, feature subsets and random thresholds are those of a run of that policy alone,
and so are its trees and predictions.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.operators import growth as G
from grove.operators import histogram as Hg
from grove.operators.forest import ForestModel, IncrementalForest, assign_fates
from grove.session import new_work_path
from grove.sources.batches import BatchStore

SCORE_ROWS = 2000  # rows scored at once: their votes are held for every unit


@dataclass
class Unit:
    born: int
    max_depth: int
    stats: int  # version whose leaf histograms are this unit's
    nodes: dict = field(default_factory=dict)  # node id -> row


class PolicyGrid:
    """The forests of all ``policies`` (regrow, incremental) after each batch."""

    def __init__(self, est: IncrementalForest, policies: Sequence[tuple[float | str, float]]):
        if est.spec.num_classes < 2:
            raise ValueError("a policy grid compares classification errors")
        if not est.params.store_leaf_stats:
            raise ValueError("growing trees further needs leaf statistics")
        self.est, self.policies = est, list(policies)
        self.units: dict[int, Unit] = {}
        self.members: list[list[list]] = []  # per policy and tree: [unit, weight]
        self.version, self.rows_seen, self.splits, self.root, self._next = -1, 0, None, None, 0

    def _unit(self, tree: int, **kw) -> int:
        self._next += 1
        uid = (self._next - 1) * self.est.params.num_trees + tree
        self.units[uid] = Unit(**kw)
        return uid

    def _stats_path(self, version: int) -> str:
        return f"{self.root}/version={version}"

    def _grow(self, data: DataFrame, state: G.GrowState, frontier: list, stored: DataFrame | None) -> None:
        e, p = self.est, self.est.params
        state = G.grow(data, e.spec.names, e.spec.arity, self.splits, e.spec.num_classes, p, state,
                       {u: self.units[u].max_depth for u in {k[0] for k in frontier}},
                       {u: self.units[u].born for u in {k[0] for k in frontier}}, sorted(frontier), self.version,
                       e._subset_k(), p.num_trees, "label", "weight" if e.spec.weight else None, stored,
                       self._stats_path(self.version), draw_mod=p.num_trees)
        if state.finish:
            state.finish()
        for (u, n), row in state.nodes.items():
            self.units[u].nodes[n] = row

    def fit(self, batch: DataFrame) -> None:
        """The first batch: one forest for all policies."""
        e, p = self.est, self.est.params
        self.root = new_work_path(batch.sparkSession, "grid")
        data = e._prepared(batch)
        info = e._validate(data)
        self.splits = e._find_splits(data, int(info["n"]))
        self.version, self.rows_seen = 0, int(info["n"])
        state, frontier, first = G.GrowState(), [], []
        for t in range(p.num_trees):
            u = self._unit(t, born=0, max_depth=p.max_depth, stats=0)
            state.nodes[(u, 1)] = G.root_row(u, Hg.channels(e.spec.num_classes))
            frontier.append((u, 1))
            first.append(u)
        self._grow(data, state, frontier, None)
        self.members = [[[u, 1.0] for u in first] for _ in self.policies]
        data.unpersist()

    def update(self, batch: DataFrame) -> None:
        """The next batch: fates by policy, then one growth of all units they touch."""
        e, p = self.est, self.est.params
        data = e._prepared(batch)
        n_new = int(e._validate(data)["n"])
        self.version += 1
        v, T = self.version, p.num_trees
        grown, replaced = {}, {}  # old unit -> its grown successor; tree -> its replacement
        state, frontier = G.GrowState(), []
        for (regrow, incremental), trees in zip(self.policies, self.members):
            if regrow == "ratio":
                regrow = n_new / float(self.rows_seen + n_new) if n_new else 0.0
            now = pd.DataFrame(dict(tree_id=range(T), weight=[w - 1.0 / T for _, w in trees],
                                    max_depth=[self.units[u].max_depth for u, _ in trees]))
            for t, fate in enumerate(assign_fates(now, v, float(regrow), float(incremental), p.seed)):
                old = trees[t][0]
                if fate == "keep":
                    trees[t][1] -= 1.0 / T
                elif fate == "grow":
                    if old not in grown:
                        was = self.units[old]
                        u = grown[old] = self._unit(t, born=was.born, max_depth=min(was.max_depth + 1, G.MAX_DEPTH_LIMIT), stats=v)
                        for i, row in was.nodes.items():
                            state.nodes[(u, i)] = dict(row, tree_id=u)
                            if row["is_leaf"]:
                                frontier.append((u, i))
                    trees[t] = [grown[old], 1.0]
                else:
                    if t not in replaced:
                        u = replaced[t] = self._unit(t, born=v, max_depth=p.max_depth, stats=v)
                        state.nodes[(u, 1)] = G.root_row(u, Hg.channels(e.spec.num_classes))
                        frontier.append((u, 1))
                    trees[t] = [replaced[t], 1.0]
        if frontier:
            self._grow(data, state, frontier, self._stored(data.sparkSession, grown))
        self.rows_seen += n_new
        live = {u for trees in self.members for u, _ in trees}
        self.units = {u: x for u, x in self.units.items() if u in live}
        data.unpersist()

    def _stored(self, spark: SparkSession, grown: dict[int, int]) -> DataFrame | None:
        """Leaf histograms of the grown units' predecessors, under the new numbers."""
        from grove.sources.model_store import _exists
        by_version: dict[int, list] = {}
        for old, new in grown.items():
            by_version.setdefault(self.units[old].stats, []).append((old, new))
        out = None
        for v, pairs in sorted(by_version.items()):
            if not _exists(spark, self._stats_path(v)):
                continue  # no leaf of that version had data
            names = spark.createDataFrame(pairs, "tree_id int, unit int")
            part = spark.read.parquet(self._stats_path(v)).join(F.broadcast(names), "tree_id")  # a row a unit
            part = part.withColumn("tree_id", F.col("unit")).drop("unit")
            out = part if out is None else out.unionByName(part)
        return out

    def model(self, policy: int) -> ForestModel:
        """The forest of one policy, trees numbered from 0."""
        rows, trees = [], []
        for t, (u, w) in enumerate(self.members[policy]):
            x = self.units[u]
            rows += [dict(r, tree_id=t) for r in x.nodes.values()]
            trees.append(dict(tree_id=t, weight=w, max_depth=x.max_depth, born_version=x.born, stats_version=x.stats, origin="grid"))
        nodes = pd.DataFrame(rows)[G.NODE_COLUMNS].sort_values(["tree_id", "node_id"]).reset_index(drop=True)
        return ForestModel(self.est.spec, self.est.params, self.splits, pd.DataFrame(trees), nodes, self.version, self.root,
                           self.rows_seen)

    def right(self, test: DataFrame) -> DataFrame:
        """(policy, ok, n) over ``test``: rows that each policy's forest gets right."""
        from grove.operators.score import _payload
        spec = self.est.spec
        uids = sorted({u for trees in self.members for u, _ in trees})
        every = ForestModel(
            spec, self.est.params, self.splits, pd.DataFrame(dict(tree_id=uids, weight=1.0)),
            pd.DataFrame([dict(r, tree_id=u) for u in uids for r in self.units[u].nodes.values()])[G.NODE_COLUMNS],
            self.version, self.root, self.rows_seen)
        ballots: dict = {}  # equal units and weights vote alike
        for i, trees in enumerate(self.members):
            ballots.setdefault(tuple((u, w) for u, w in trees), []).append(i)
        at = {u: k for k, u in enumerate(uids)}
        bc = test.sparkSession.sparkContext.broadcast(
            (_payload(every), [([(at[u], w) for u, w in b], who) for b, who in ballots.items()]))
        names, arity, on_missing = list(spec.names), [int(a) for a in spec.arity], self.est.params.on_missing

        def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p, ballots = bc.value
            fo, splits = p["forest"], p["splits"]
            ok, n = {}, 0
            for whole in batches:
                for i in range(0, whole.num_rows, SCORE_ROWS):
                    rb = whole.slice(i, SCORE_ROWS)
                    bins = Hg.bin_matrix(rb, names, splits, arity, on_missing)
                    y = rb.column("label").to_numpy(zero_copy_only=False)
                    n += rb.num_rows
                    votes = [p["val"][fo.route(k, bins)] for k in range(len(fo.tree_ids))]
                    for j, (ballot, _) in enumerate(ballots):
                        raw = np.zeros((rb.num_rows, p["k"]))
                        for k, w in ballot:
                            raw += votes[k] * w
                        ok[j] = ok.get(j, 0) + int((np.argmax(raw, axis=1) == y).sum())
            if n:
                rows = [(i, ok[j]) for j, (_, who) in enumerate(ballots) for i in who]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in rows], pa.int32()), pa.array([k for _, k in rows], pa.int64()),
                     pa.array([n] * len(rows), pa.int64())], names=["policy", "ok", "n"])

        rows = test.select(F.col(spec.label).cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in names])
        return rows.mapInArrow(fn, "policy int, ok long, n long").groupBy("policy").agg(F.sum("ok").alias("ok"), F.sum("n").alias("n"))


def grid_errors(est: IncrementalForest, policies: Sequence[tuple[float | str, float]], batches: DataFrame | BatchStore,
                batch_col: str = "batch", holdout: int | None = None) -> DataFrame:
    """Metrics rows (S5 shape) of every policy after every batch, tested on the
    hold-out batch or else on the next one.  ``seconds`` is the step's time, which all
    policies share; an empty test batch counts as an error of 1, as in E2."""
    from grove.operators.evaluate import METRICS_SCHEMA
    store = batches if isinstance(batches, BatchStore) else BatchStore.write(batches, batch_col=batch_col)
    ids = [b for b in store.ids() if b != holdout]
    grid, rows = PolicyGrid(est, policies), []
    for i, b in enumerate(ids):
        test_id = holdout if holdout is not None else (ids[i + 1] if i + 1 < len(ids) else None)
        if test_id is None:
            break
        began = time.time()
        grid.fit(store.read(b)) if grid.version < 0 else grid.update(store.read(b))
        secs = time.time() - began
        got = {r["policy"]: r for r in grid.right(store.read(test_id)).collect()}  # a row a policy
        for k, (r, p) in enumerate(grid.policies):
            acc = round(got[k]["ok"] / got[k]["n"], 6) if k in got else 0.0
            rows.append((None if r == "ratio" else float(r), float(p), int(b), grid.rows_seen, secs, 1.0 - acc))
    return store.spark.createDataFrame(rows, METRICS_SCHEMA)
