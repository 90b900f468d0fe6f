"""The incremental forest estimator: fit (T9-T12), update (I1-I12),
add_trees (I9), and the versioned model it produces.

    forest = IncrementalForest(spec, ForestParams(num_trees=100, max_depth=10))
    m0 = forest.fit(batch0, path)        # version 0
    m1 = forest.update(m0, batch1)       # version 1: decay, fates, grow/keep/replace
    scored = m1.transform(test)          # raw, probability, prediction
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.functions import hashing as H
from grove.operators import growth as G
from grove.operators import histogram as Hg
from grove.operators.features import FeatureSpec
from grove.operators.sampling import (SEED_FATE, quantile_fraction, quantile_sample,
                                      subset_size, union_batches)
from grove.operators.splits import Splits, find_splits
from grove.session import default_parallelism, new_work_path
from grove.sources import model_store as MS


# --------------------------------------------------------------------- I10
# Update strategies as (regrow_prop, incremental_prop):
#   default      - no update; retrain on all data seen (B5 + fit)
#   batched      - grow every tree with each batch
#   replacement  - replace a share of trees, keep the rest
#   combined     - grow some, replace some, keep the rest
PRESETS = {
    "default": (0.0, 0.0),
    "batched": (0.0, 1.0),
    "replacement": (0.3, 0.0),
    "combined": (0.2, 0.5),
}


def preset(name: str, **overrides) -> "G.ForestParams":
    r, p = PRESETS[name]
    return G.ForestParams(regrow_prop=r, incremental_prop=p, **overrides)


# ---------------------------------------------------------------------- I3
def fate_uniforms(tree_ids, version: int, seed: int):
    t = np.asarray(tree_ids, dtype=np.int64)
    return (H.uniform_np(SEED_FATE + seed, np.int64(version), t, np.int64(1)),
            H.uniform_np(SEED_FATE + seed, np.int64(version), t, np.int64(2)))


def assign_fates(trees: pd.DataFrame, new_version: int, regrow: float, incremental: float,
                 seed: int) -> list[str]:
    """I3: 'replace' when the decayed weight is below 0.1 or the tree hit
    the depth limit; else 'grow' with probability p; else 'keep' with
    probability 1 - r/(1-p) of the rest; else 'replace'."""
    u1, u2 = fate_uniforms(trees.tree_id.to_numpy(), new_version, seed)
    out = []
    for w, d, a, b in zip(trees.weight, trees.max_depth, u1, u2):
        if w < 0.1 or d == G.MAX_DEPTH_LIMIT:
            out.append("replace")
        elif a < incremental:
            out.append("grow")
        elif incremental < 1 and b < 1 - regrow / (1 - incremental):
            out.append("keep")
        else:
            out.append("replace")
    return out


def fate_column(weight, max_depth, tree_id, new_version: int, regrow: float, incremental: float,
                seed: int):
    """Same as ``assign_fates`` as a Column (for tables of trees)."""
    u1 = H.uniform(SEED_FATE + seed, F.lit(new_version), tree_id, F.lit(1))
    u2 = H.uniform(SEED_FATE + seed, F.lit(new_version), tree_id, F.lit(2))
    keep_cond = F.lit(incremental < 1) & (u2 < F.lit(1 - regrow / (1 - incremental))
                                         if incremental < 1 else F.lit(False))
    return (F.when((weight < 0.1) | (max_depth == G.MAX_DEPTH_LIMIT), F.lit("replace"))
            .when(u1 < F.lit(float(incremental)), F.lit("grow"))
            .when(keep_cond, F.lit("keep")).otherwise(F.lit("replace")))


# ------------------------------------------------------------------- model
@dataclass
class ForestModel:
    spec: FeatureSpec
    params: G.ForestParams
    splits: Splits
    trees: pd.DataFrame
    nodes: pd.DataFrame
    version: int
    root: str
    rows_seen: int
    history: list = field(default_factory=list)

    @property
    def num_classes(self) -> int:
        return self.spec.num_classes

    def nodes_df(self, spark: SparkSession) -> DataFrame:
        return MS.nodes_frame(spark, self.nodes)

    def trees_df(self, spark: SparkSession) -> DataFrame:
        return MS.trees_frame(spark, self.trees)

    def leaf_stats(self, spark: SparkSession) -> DataFrame | None:
        return MS.leaf_stats(spark, self.root, self.trees)

    def transform(self, df: DataFrame, keep=None) -> DataFrame:
        from grove.operators.score import transform
        return transform(self, df, keep)

    def meta(self) -> dict:
        return dict(names=list(self.spec.names), arity=[int(a) for a in self.spec.arity],
                    num_classes=int(self.spec.num_classes), label=self.spec.label,
                    params=self.params.to_dict(), rows_seen=int(self.rows_seen),
                    bin_counts=[int(b) for b in self.splits.num_bins],
                    unordered=[bool(u) for u in self.splits.unordered])

    def save(self, spark: SparkSession, mode: str = "error", extra=(), attempt: str | None = None,
             stream: tuple[str, int] | None = None) -> "ForestModel":
        MS.save_version(spark, self.root, self.version, self.meta(), self.splits.to_rows(),
                        self.trees, self.nodes, mode, extra, attempt, stream)
        return self

    @staticmethod
    def load(spark: SparkSession, root: str, version: int | None = None) -> "ForestModel":
        d = MS.load_version(spark, root, version)
        m = d["meta"]
        params = G.ForestParams(**json.loads(m["params"]))
        spec = FeatureSpec(list(m["names"]), [int(a) for a in m["arity"]], m["label"],
                           int(m["num_classes"]))
        th = MS.thresholds_from(d["splits"], len(spec.names))
        splits = Splits(th, [int(b) for b in m["bin_counts"]], [bool(u) for u in m["unordered"]])
        nodes = d["nodes"][G.NODE_COLUMNS].sort_values(["tree_id", "node_id"]).reset_index(drop=True)
        return ForestModel(spec, params, splits, d["trees"], nodes, d["version"], root,
                           int(m["rows_seen"]))


# --------------------------------------------------------------- estimator
class IncrementalForest:
    def __init__(self, spec: FeatureSpec, params: G.ForestParams | None = None):
        self.spec = spec
        self.params = params or G.ForestParams()
        if self.params.max_depth > G.MAX_DEPTH_LIMIT:
            raise ValueError(f"max_depth above {G.MAX_DEPTH_LIMIT}")

    # --- helpers
    def _prepared(self, df: DataFrame) -> DataFrame:
        s = self.spec
        cols = [F.col(s.key).cast("bigint").alias("rk"),
                F.col(s.label).cast("double").alias("label")]
        if s.weight:
            cols.append(F.coalesce(F.col(s.weight).cast("double"), F.lit(1.0)).alias("weight"))
        cols += [F.col(n).cast("double").alias(n) for n in s.names]
        out = df.select(*cols)
        n = default_parallelism(df.sparkSession)
        if out.rdd.getNumPartitions() < n:
            out = out.repartition(n, F.col("rk"))
        return out.persist(StorageLevel.MEMORY_AND_DISK)

    def _validate(self, data: DataFrame) -> dict:
        """I1 + A11: one aggregate over the batch."""
        y = F.col("label")
        aggs = [F.count(F.lit(1)).alias("n"), F.min(y).alias("ymin"), F.max(y).alias("ymax"),
                F.sum(F.when(y != F.floor(y), 1).otherwise(0)).alias("frac"),
                F.sum(F.when(y.isNull() | F.isnan(y), 1).otherwise(0)).alias("ynull")]
        aggs += [F.sum(F.when(F.col(c).isNull() | F.isnan(c), 1).otherwise(0)).alias(f"m{i}")
                 for i, c in enumerate(self.spec.names)]
        r = data.agg(*aggs).first().asDict()
        k = self.spec.num_classes
        if r["n"] and k > 0:
            if r["ynull"] or r["frac"] or r["ymin"] < 0 or r["ymax"] >= k:
                raise ValueError(f"labels must be integers in [0, {k}): min {r['ymin']}, "
                                 f"max {r['ymax']}, fractional {r['frac']}, null {r['ynull']}")
        missing = sum(r[f"m{i}"] or 0 for i in range(len(self.spec.names)))
        if missing and self.params.on_missing == "error":
            raise ValueError(f"{missing} null or NaN feature values (on_missing='keep' "
                             "sends them right)")
        return r

    def _subset_k(self) -> int:
        return subset_size(self.params.feature_subset, len(self.spec.names),
                           self.params.num_trees, self.spec.num_classes > 0)

    def _check_compatible(self, model: "ForestModel") -> None:
        """The batch's features and the settings that stored statistics
        depend on must be those of the model."""
        a, b = self.spec, model.spec
        for what, mine, theirs in (
                ("features", list(a.names), list(b.names)), ("classes", a.num_classes, b.num_classes),
                ("category counts", [int(x) for x in a.arity], [int(x) for x in b.arity]),
                ("impurity", self.params.impurity, model.params.impurity),
                ("largest bin number", self.params.max_bins, model.params.max_bins)):
            if mine != theirs:
                raise ValueError(f"{what} {mine} differ from the model's {theirs}")
        if len(model.splits.thresholds) != len(a.names):
            raise ValueError("the model's stored splits do not cover the features")

    def _grow(self, data, splits, state, max_depth, born, frontier, version, root, attempt, stored=None):
        p = self.params
        return G.grow(data, self.spec.names, self.spec.arity, splits, self.spec.num_classes, p,
                      state, max_depth, born, frontier, version, self._subset_k(), p.num_trees,
                      "label", "weight" if self.spec.weight else None, stored,
                      f"{MS.attempt_path(root, attempt)}/leaf_stats")

    def _find_splits(self, data: DataFrame, n: int) -> Splits:
        p = self.params
        frac = quantile_fraction(p.max_bins, n)
        sample = quantile_sample(data, frac, "rk", p.seed)
        # the sample is bounded by max(max_bins^2, 10000) rows in expectation
        splits, _ = find_splits(sample, self.spec.names, self.spec.arity,
                                self.spec.num_classes, p.max_bins)
        return splits

    # --- T9
    def fit(self, df: DataFrame, path: str | None = None, mode: str = "error",
            splits: Splits | None = None, stream: tuple[str, int] | None = None,
            report: dict | None = None) -> ForestModel:
        """``report``: see ``update``."""
        spark = df.sparkSession
        t0 = time.time()
        root = path or new_work_path(spark, "forest")
        if mode != "overwrite" and MS.version_exists(spark, root, 0):
            raise FileExistsError(f"{root} already holds a model")
        attempt = MS.new_attempt()
        data = self._prepared(df)
        info = self._validate(data)
        splits = splits or self._find_splits(data, int(info["n"]))
        p = self.params
        C = Hg.channels(self.spec.num_classes)
        state = G.GrowState()
        for t in range(p.num_trees):
            state.nodes[(t, 1)] = G.root_row(t, C)
        max_depth = {t: p.max_depth for t in range(p.num_trees)}
        born = {t: 0 for t in range(p.num_trees)}
        state = self._grow(data, splits, state, max_depth, born, [(t, 1) for t in range(p.num_trees)],
                           0, root, attempt)
        trees = pd.DataFrame(dict(tree_id=list(range(p.num_trees)), weight=1.0,
                                  max_depth=p.max_depth, born_version=0, stats_version=0,
                                  origin="fit"))
        model = ForestModel(self.spec, p, splits, trees, state.frame(), 0, root, int(info["n"]),
                            [dict(version=0, rows=int(info["n"]), seconds=time.time() - t0)])
        model.save(spark, mode, [state.finish, self._report(spark, model, attempt, report)], attempt, stream)
        data.unpersist()
        return model

    def _report(self, spark: SparkSession, model: ForestModel, attempt: str, report: dict | None):
        """Writes the version's metrics row into its own attempt."""
        if report is None:
            return None
        p = self.params
        row = (None if p.regrow_prop == "ratio" else float(p.regrow_prop), float(p.incremental_prop), int(report["batch"]),
               int(model.rows_seen), float(model.history[-1]["seconds"]), report.get("error"))
        return lambda: MS.write_metrics_row(spark, model.root, attempt, row)

    # --- I10
    @classmethod
    def for_strategy(cls, spec: FeatureSpec, name: str, **settings) -> "IncrementalForest":
        """An estimator with the settings of a named update strategy."""
        est = cls(spec, preset(name, **settings))
        est.strategy = name
        return est

    def advance(self, model: ForestModel | None, batch: DataFrame, seen: list[DataFrame] = ()) -> ForestModel:
        """The next model by the estimator's strategy: 'default' retrains on all
        batches ``seen`` and this one, the others update ``model``."""
        if model is None:
            return self.fit(batch)
        if getattr(self, "strategy", None) == "default":
            return self.fit(union_batches([*seen, batch]))
        return self.update(model, batch)

    # --- I7
    def update(self, model: ForestModel, df: DataFrame, mode: str = "error",
               stream: tuple[str, int] | None = None, report: dict | None = None) -> ForestModel:
        """The next version.  With ``report`` (batch, error) the version keeps a
        metrics row: it belongs to the same attempt, so it counts if and only if
        the version does."""
        spark = df.sparkSession
        t0 = time.time()
        s, p = self.spec, self.params
        self._check_compatible(model)
        attempt = MS.new_attempt()
        data = self._prepared(df)
        info = self._validate(data)
        n_new = int(info["n"])
        v = model.version + 1
        trees = model.trees.copy()
        trees["weight"] = trees["weight"] - 1.0 / len(trees)  # I2
        regrow = p.regrow_prop
        if regrow == "ratio":  # I12
            regrow = n_new / float(model.rows_seen + n_new) if n_new else 0.0
        fates = assign_fates(trees, v, float(regrow), float(p.incremental_prop), p.seed)
        trees["origin"] = ["grown" if f == "grow" else ("kept" if f == "keep" else "replaced")
                           for f in fates]
        C = Hg.channels(s.num_classes)
        state = G.GrowState()
        fate_of = dict(zip((int(t) for t in trees.tree_id), fates))
        leaves_of: dict = {}  # the nodes once, by tree
        for r in model.nodes.to_dict("records"):
            key = (int(r["tree_id"]), int(r["node_id"]))
            if fate_of[key[0]] != "replace":
                state.nodes[key] = dict(r)
                if r["is_leaf"]:
                    leaves_of.setdefault(key[0], []).append(key)
        frontier, max_depth, born = [], {}, {}
        for i, (tid, fate) in enumerate(zip(trees.tree_id, fates)):
            tid = int(tid)
            if fate == "grow":  # I4: reopen leaves, one more level allowed
                trees.loc[i, "max_depth"] = min(int(trees.loc[i, "max_depth"]) + 1,
                                                G.MAX_DEPTH_LIMIT)
                trees.loc[i, "weight"] = 1.0
                trees.loc[i, "stats_version"] = v
                frontier += leaves_of.get(tid, [])
            elif fate == "replace":  # I5: new root on this batch only
                trees.loc[i, ["weight", "max_depth", "born_version", "stats_version"]] = \
                    [1.0, p.max_depth, v, v]
                state.nodes[(tid, 1)] = G.root_row(tid, C)
                frontier.append((tid, 1))
            max_depth[tid] = int(trees.loc[i, "max_depth"])
            born[tid] = int(trees.loc[i, "born_version"])
        # stored leaf histograms of the grown trees, read from the versions
        # the OLD model points at (their new stats_version is being written)
        grown_ids = set(trees.tree_id[trees.origin == "grown"])
        grown_old = model.trees[model.trees.tree_id.isin(grown_ids)]
        stored = MS.leaf_stats(spark, model.root, grown_old) if len(grown_old) else None
        if frontier:
            state = self._grow(data, model.splits, state, max_depth, born, sorted(frontier), v,
                               model.root, attempt, stored)
        trees = trees.astype({"max_depth": int, "born_version": int, "stats_version": int})
        new = ForestModel(s, p, model.splits, trees, state.frame(), v, model.root,
                          model.rows_seen + n_new,
                          model.history + [dict(version=v, rows=n_new,
                                                seconds=time.time() - t0)])
        new.save(spark, mode, [state.finish, self._report(spark, new, attempt, report)], attempt, stream)
        data.unpersist()
        return new

    # --- I9
    def add_trees(self, model: ForestModel, df: DataFrame, count: int,
                  mode: str = "error") -> ForestModel:
        """Warm start: ``count`` new trees fit on ``df`` with the model's
        frozen splits, appended to the model as a new version."""
        spark = df.sparkSession
        self._check_compatible(model)
        attempt = MS.new_attempt()
        data = self._prepared(df)
        info = self._validate(data)
        v = model.version + 1
        C = Hg.channels(self.spec.num_classes)
        first = int(model.trees.tree_id.max()) + 1 if len(model.trees) else 0
        ids = list(range(first, first + count))
        state = G.GrowState()
        for r in model.nodes.to_dict("records"):
            state.nodes[(int(r["tree_id"]), int(r["node_id"]))] = dict(r)
        for t in ids:
            state.nodes[(t, 1)] = G.root_row(t, C)
        max_depth = {t: self.params.max_depth for t in ids}
        born = {t: v for t in ids}
        state = self._grow(data, model.splits, state, max_depth, born, [(t, 1) for t in ids], v,
                           model.root, attempt)
        added = pd.DataFrame(dict(tree_id=ids, weight=1.0, max_depth=self.params.max_depth,
                                  born_version=v, stats_version=v, origin="added"))
        trees = pd.concat([model.trees, added], ignore_index=True)
        new = ForestModel(self.spec, self.params, model.splits, trees, state.frame(), v,
                          model.root, model.rows_seen + int(info["n"]), model.history)
        new.save(spark, mode, [state.finish], attempt)
        data.unpersist()
        return new
