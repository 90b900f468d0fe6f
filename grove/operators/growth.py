"""Split search and tree growth, T1-T12.

Split search runs on executors over the merged histogram:

* continuous features: running class sums over bins (T2),
* ordered categorical features: categories sorted by centroid (mean label
  for binary and regression, impurity for multiclass), then running sums
  in that order (T4),
* unordered categorical features: candidate subsets joined to the bins they
  contain (T3),
* extremely randomised mode keeps one hashed candidate per feature (T6),

then ``max_by`` picks the best candidate per node: highest gain, then the
lower feature, then the earlier candidate (T5).  Every window is over one
(tree, node, feature): at most ``max_bins`` rows.

The level loop (T9) keeps the trees on the driver - one row per node,
bounded by trees x 2^depth - and runs one histogram pass per level (cut into
chunks of nodes so a task's buffer stays under ``max_memory_mb``).  Leaf
histograms are appended to the model's ``leaf_stats`` table as they are
found (I8), straight from executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, asdict
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grove.functions import hashing as H
from grove.functions import impurity as I
from grove.operators import histogram as Hg
from grove.operators.sampling import SEED_ERF
from grove.operators.splits import Splits, unordered_subsets

MAX_DEPTH_LIMIT = 30

NODE_COLUMNS = ["tree_id", "node_id", "is_leaf", "feature", "split_idx", "threshold",
                "left_categories", "gain", "impurity", "count", "stats", "prediction"]


@dataclass
class ForestParams:
    num_trees: int = 10
    max_depth: int = 5
    max_bins: int = 32
    min_instances_per_node: float = 1.0
    min_info_gain: float = 0.0
    impurity: str = "gini"
    subsampling_rate: float = 1.0
    feature_subset: str | float = "auto"
    seed: int = 0
    regrow_prop: float | str = 0.0
    incremental_prop: float = 1.0
    erf: bool = False
    max_memory_mb: int = 256
    store_leaf_stats: bool = True
    on_missing: str = "error"  # "error" or "keep" (null/NaN go right)

    def to_dict(self):
        return asdict(self)


def level_of(node_id: int) -> int:
    return int(node_id).bit_length() - 1


# ------------------------------------------------------------ candidates
def _cand_columns(C: int):
    return ([f"l{c}" for c in range(C)], [f"t{c}" for c in range(C)])


def split_candidates(hist: DataFrame, arity: Sequence[int], splits: Splits, num_classes: int,
                     erf: bool = False, seed: int = 0, version: int = 0,
                     kind: str = "gini", draw_mod: int | None = None) -> DataFrame:
    """All candidate splits with left and total statistics:
    (tree_id, node_id, feature, cand, split_idx, left_categories, l*, t*, _ok).
    Rows that cannot be a split (the last bin or category, or not the drawn
    candidate in randomised mode) are kept with ``_ok`` false: they still
    carry the node totals, so one aggregation yields totals and best split."""
    C = Hg.channels(num_classes)
    S = Hg.hist_columns(num_classes)
    L, T = _cand_columns(C)
    key = ["tree_id", "node_id", "feature"]
    part = Window.partitionBy(*key)
    nb = F.element_at(F.array(*[F.lit(int(x)) for x in splits.num_bins]), F.col("feature") + 1)
    cont = [f for f, a in enumerate(arity) if a == 0]
    ordc = [f for f, a in enumerate(arity) if a > 0 and not splits.unordered[f]]
    unord = [f for f, a in enumerate(arity) if a > 0 and splits.unordered[f]]
    draw = F.pmod("tree_id", F.lit(draw_mod)) if draw_mod else F.col("tree_id")
    u_erf = (H.uniform(SEED_ERF + seed, F.lit(version), draw, F.col("node_id"),
                       F.col("feature")) if erf else None)
    parts = []
    if cont:
        # written as SQL text: one call to the JVM per expression instead of
        # one per Column operation (plan building was a third of a level)
        src = hist if len(cont) == len(arity) else hist.where(F.col("feature").isin(cont))
        nb_sql = f"element_at(array({', '.join(str(int(x)) for x in splits.num_bins)}), feature + 1)"
        wpart = "PARTITION BY tree_id, node_id, feature"
        hc = src.selectExpr(
            *key, "bin AS cand", "bin AS split_idx", "CAST(array() AS array<int>) AS left_categories",
            f"{nb_sql} AS _nb",
            *[f"sum({s}) OVER ({wpart} ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND "
              f"CURRENT ROW) AS {l}" for s, l in zip(S, L)],
            *[f"sum({s}) OVER ({wpart}) AS {t}" for s, t in zip(S, T)],
            f"bin < {nb_sql} - 1 AS _ok")
        if erf:
            # one random threshold per feature; its left side holds the bins
            # up to the nearest populated bin at or below it
            hc = hc.withColumn("_k", F.floor(u_erf * (F.col("_nb") - 1)).cast("int"))
            # rows above the drawn threshold stay as invalid candidates (they
            # still carry the node totals)
            hc = hc.withColumn("_ok", F.col("_ok") & (F.col("cand") <= F.col("_k")))
            hc = (hc.withColumn("_r", F.row_number().over(
                      part.orderBy(F.desc("_ok"), F.desc("cand"))))
                  .where(F.col("_r") == 1)
                  .withColumn("split_idx", F.when(F.col("_ok"), F.col("_k")).otherwise(F.col("cand")))
                  .withColumn("cand", F.col("split_idx")).drop("_r", "_k"))
        parts.append(hc.drop("_nb"))
    if ordc:
        s = [F.col(x) for x in S]
        if num_classes == 2:
            cen = s[1] / (s[0] + s[1])
        elif num_classes == 0:
            cen = s[1] / s[0]
        else:
            cen = I.impurity(kind, s)
        ho = hist.where(F.col("feature").isin(ordc)).withColumn("_cen", cen)
        wo = part.orderBy("_cen", "bin")
        wr = wo.rowsBetween(Window.unboundedPreceding, 0)
        ho = ho.select(*key, F.row_number().over(wo).alias("cand"), F.lit(-1).alias("split_idx"),
                       F.collect_list("bin").over(wr).alias("left_categories"),
                       F.count(F.lit(1)).over(part).alias("_n"),
                       *[F.sum(x).over(wr).alias(l) for x, l in zip(S, L)],
                       *[F.sum(x).over(part).alias(t) for x, t in zip(S, T)])
        ho = ho.withColumn("_ok", F.col("cand") < F.col("_n"))
        if erf:
            k = (F.floor(u_erf * (F.col("_n") - 1)) + 1).cast("int")
            ho = ho.withColumn("_ok", F.col("_ok") & (F.col("cand") == k))
        parts.append(ho.drop("_n"))
    if unord:
        spark = hist.sparkSession
        ar = spark.createDataFrame([(f, int(arity[f])) for f in unord], "feature int, arity int")
        sub = unordered_subsets(ar)  # bounded: sum over features of 2^(arity-1)
        hu = hist.where(F.col("feature").isin(unord))
        tot = hu.groupBy(*key).agg(*[F.sum(x).alias(t) for x, t in zip(S, T)])
        left = (hu.join(F.broadcast(sub), "feature")
                .where(F.expr("(left_mask >> bin) & 1 = 1"))
                .groupBy(*key, "split_idx", "categories")
                .agg(*[F.sum(x).alias(l) for x, l in zip(S, L)]))
        cu = left.join(tot, key).select(
            *key, F.col("split_idx").alias("cand"), F.lit(-1).alias("split_idx"),
            F.split("categories", ",").cast("array<int>").alias("left_categories"), *L, *T,
            F.lit(True).alias("_ok"))
        if erf:
            n = F.pow(F.lit(2), F.element_at(F.array(*[F.lit(int(a)) for a in arity]),
                                             F.col("feature") + 1) - 1) - 1
            cu = cu.withColumn("_ok", F.col("cand") == F.floor(u_erf * n).cast("int"))
        parts.append(cu)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scored_candidates(cands: DataFrame, num_classes: int, kind: str,
                      min_instances: float) -> DataFrame:
    """Gain of each candidate; validity by child counts (one projection,
    so the plan is analysed once)."""
    C = Hg.channels(num_classes)
    L, T = _cand_columns(C)
    R = [f"({t} - {l})" for t, l in zip(T, L)]
    if kind.lower() == "variance":
        nl, nt = L[0], T[0]
    else:
        nl, nt = "(" + " + ".join(L) + ")", "(" + " + ".join(T) + ")"
    nr = f"({nt} - {nl})"
    # same formula as the Column builders in functions.impurity, as SQL text
    gain = (f"{I.impurity_sql(kind, T)} - ({nl} / {nt}) * {I.impurity_sql(kind, L)} "
            f"- ({nr} / {nt}) * {I.impurity_sql(kind, R)}")
    mi = repr(float(min_instances))
    return cands.selectExpr("*", f"{nl} AS left_count", f"{nr} AS right_count", f"{gain} AS gain",
                            f"_ok AND {nl} >= {mi} AND {nr} >= {mi} AS valid")


def best_splits(hist: DataFrame, arity: Sequence[int], splits: Splits, num_classes: int,
                kind: str, min_instances: float, min_info_gain: float, erf: bool = False,
                seed: int = 0, version: int = 0, draw_mod: int | None = None) -> DataFrame:
    """T5: per (tree, node): totals of the node and its best valid split
    (null fields when none)."""
    C = Hg.channels(num_classes)
    L, T = _cand_columns(C)
    S = Hg.hist_columns(num_classes)
    sc = scored_candidates(split_candidates(hist, arity, splits, num_classes, erf, seed, version, kind, draw_mod),
                           num_classes, kind, min_instances)
    # one aggregation per node: totals (equal on every candidate row of the
    # node) and the best valid candidate (valid first, then gain, then the
    # lower feature, then the earlier candidate)
    ok = f"valid AND gain >= {repr(float(min_info_gain))}"
    agg = sc.selectExpr("tree_id", "node_id", *T, "feature", "cand", "split_idx",
                        "left_categories", "gain", *L, f"{ok} AS ok").groupBy(
        "tree_id", "node_id").agg(
        F.expr(f"min_by(struct({', '.join(T)}), struct(feature, cand))").alias("tot"),
        F.expr(f"max_by(struct(ok, feature, cand, split_idx, left_categories, gain, "
               f"{', '.join(L)}), struct(ok, gain, -feature, -cand))").alias("b"))
    return agg.selectExpr("tree_id", "node_id", "tot", "CASE WHEN b.ok THEN b END AS b")


def node_totals(hist: DataFrame, num_classes: int) -> DataFrame:
    """Totals per node (the same on every feature of the node)."""
    C = Hg.channels(num_classes)
    S = Hg.hist_columns(num_classes)
    T = [f"t{c}" for c in range(C)]
    return (hist.groupBy("tree_id", "node_id", "feature")
            .agg(*[F.sum(s).alias(t) for s, t in zip(S, T)])
            .groupBy("tree_id", "node_id")
            .agg(F.min_by(F.struct(*T), F.col("feature")).alias("tot"))
            .withColumn("b", F.lit(None).cast("struct<ok:boolean>")))


# ------------------------------------------------------------- impurity (py)
def impurity_py(kind: str, stats: Sequence[float]) -> float:
    kind = kind.lower()
    if kind == "variance":
        n, s, s2 = stats
        return 0.0 if n == 0 else (s2 - (s * s) / n) / n
    t = 0.0
    for c in stats:
        t = t + c
    if t == 0:
        return 0.0
    if kind == "gini":
        sq = 0.0
        for c in stats:
            sq = sq + (c / t) * (c / t)
        return 1.0 - sq
    acc = 0.0
    for c in stats:
        if c != 0:
            p = c / t
            acc = acc + (-p * math.log2(p))
    return acc


def count_py(kind: str, stats: Sequence[float]) -> float:
    return float(stats[0]) if kind.lower() == "variance" else float(sum(stats))


def predict_py(kind: str, stats: Sequence[float]) -> float:
    if kind.lower() == "variance":
        return 0.0 if stats[0] == 0 else stats[1] / stats[0]
    return float(int(np.argmax(np.asarray(stats)))) if len(stats) else 0.0


# ------------------------------------------------------------------ nodes
def empty_nodes() -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series(dtype=object) for c in NODE_COLUMNS})


def root_row(tree_id: int, C: int) -> dict:
    return dict(tree_id=int(tree_id), node_id=1, is_leaf=True, feature=-1, split_idx=-1,
                threshold=float("nan"), left_categories=[], gain=0.0, impurity=0.0, count=0.0,
                stats=[0.0] * C, prediction=0.0)


@dataclass
class GrowState:
    nodes: dict = field(default_factory=dict)  # (tree, node) -> row dict
    created: set = field(default_factory=set)  # nodes whose stats came from a parent split
    finish: object = None  # deferred leaf-statistics write

    def frame(self) -> pd.DataFrame:
        if not self.nodes:
            return empty_nodes()
        df = pd.DataFrame(list(self.nodes.values()))[NODE_COLUMNS]
        return df.sort_values(["tree_id", "node_id"]).reset_index(drop=True)


MAX_BROADCAST_NODES = 5_000_000  # nodes of the trees shipped with one pass


def _chunks(frontier: list, max_nodes: int, state: "GrowState"):
    """Cuts a level's frontier (sorted by tree) into passes that hold at most
    ``max_nodes`` frontier nodes (the task buffer) and whose trees have at
    most MAX_BROADCAST_NODES nodes in all (the broadcast)."""
    sizes: dict = {}
    for t, _ in state.nodes:
        sizes[t] = sizes.get(t, 0) + 1
    chunk, trees, total = [], set(), 0
    for key in frontier:
        t = key[0]
        if sizes.get(t, 0) > MAX_BROADCAST_NODES:
            raise ValueError(f"tree {t} has {sizes[t]} nodes, above the broadcast bound")
        extra = 0 if t in trees else sizes.get(t, 0)
        if chunk and (len(chunk) >= max_nodes or total + extra > MAX_BROADCAST_NODES):
            yield chunk
            chunk, trees, total = [], set(), 0
            extra = sizes.get(t, 0)
        chunk.append(key)
        if t not in trees:
            trees.add(t)
            total += extra
    if chunk:
        yield chunk


def grow(data: DataFrame, names: Sequence[str], arity: Sequence[int], splits: Splits,
         num_classes: int, params: ForestParams, state: GrowState, max_depth: dict,
         born: dict, frontier: list, version: int, subset_k: int, num_trees_bag: int,
         label: str = "label", weight: str | None = None,
         stored_hist: DataFrame | None = None, leaf_sink: str | None = None,
         draw_mod: int | None = None) -> GrowState:
    """Grow the frontier nodes level by level until every branch ends.
    ``draw_mod``: see ``histogram_pass``."""
    spark = data.sparkSession
    C = Hg.channels(num_classes)
    kind = params.impurity
    F_ = len(names)
    B = int(max(splits.num_bins)) if splits.num_bins else 1
    per_node = F_ * B * C * 8
    max_nodes = max(1, int(params.max_memory_mb * 1024 * 1024 // per_node))
    max_arity = max([int(a) for a in arity] + [1])
    first = True
    pending = []  # (persisted level histogram, its leaves) -> one write at the end
    while frontier:
        next_frontier = []
        for chunk in _chunks(sorted(frontier), max_nodes, state):
            trees_in = sorted({t for t, _ in chunk})
            nodes_pd = state.frame()
            forest = Hg.FlatForest.build(nodes_pd, trees_in, max_arity)
            hist = Hg.histogram_pass(data, names, arity, splits, num_classes, forest, born, chunk,
                                     subset_k, num_trees_bag, params.subsampling_rate,
                                     params.seed, label, weight, params.on_missing, draw_mod=draw_mod)
            if first and stored_hist is not None:
                keys = spark.createDataFrame(chunk, "tree_id int, node_id bigint")
                old = stored_hist.join(F.broadcast(keys), Hg.NODE_KEY, "left_semi")
                hist = Hg.merge_histograms([hist, old.select(*hist.columns)], num_classes)
            terminal = all(level_of(i) >= max_depth[t] and (t, i) in state.created
                           for t, i in chunk)
            if terminal:
                # nodes at the depth limit whose statistics came from their
                # parent's split: nothing to decide, the pass only feeds the
                # stored leaf histograms (written with the model, below)
                for key in chunk:
                    state.nodes[key]["is_leaf"] = True
                if leaf_sink and params.store_leaf_stats:
                    pending.append((None, hist))
                continue
            hist = hist.persist(StorageLevel.MEMORY_AND_DISK)
            if all(level_of(i) >= max_depth[t] for t, i in chunk):
                # every node here ends as a leaf: totals only, no split search
                res = node_totals(hist, num_classes).collect()
            else:
                res = best_splits(hist, arity, splits, num_classes, kind,
                                  params.min_instances_per_node, params.min_info_gain, params.erf,
                                  params.seed, version, draw_mod).collect()  # one row per node in chunk
                got = {(int(r["tree_id"]), int(r["node_id"])) for r in res}
                if any(k not in got for k in chunk):  # nodes without any candidate row
                    res += [r for r in node_totals(hist, num_classes).collect()
                            if (int(r["tree_id"]), int(r["node_id"])) not in got]
            seen = set()
            leaves = []
            for r in res:
                key = (int(r["tree_id"]), int(r["node_id"]))
                seen.add(key)
                node = state.nodes[key]
                tot = [float(r["tot"][f"t{c}"]) for c in range(C)]
                if key in state.created:
                    pstats = node["stats"]
                else:
                    pstats = tot
                    node["stats"] = tot
                node["impurity"] = impurity_py(kind, pstats)
                node["count"] = count_py(kind, pstats)
                node["prediction"] = predict_py(kind, pstats)
                b = r["b"]
                lvl = level_of(key[1])
                gain = None
                if b is not None:
                    lstats = [float(b[f"l{c}"]) for c in range(C)]
                    rstats = [t - l for t, l in zip(tot, lstats)]
                    nl, nt = count_py(kind, lstats), count_py(kind, tot)
                    nr = nt - nl
                    if key in state.created:
                        gain = (node["impurity"] - (nl / nt) * impurity_py(kind, lstats)
                                - (nr / nt) * impurity_py(kind, rstats))
                    else:
                        gain = float(b["gain"])
                    if gain < params.min_info_gain:
                        gain = None
                is_leaf = gain is None or gain <= 0 or lvl >= max_depth[key[0]]
                node["is_leaf"] = bool(is_leaf)
                if is_leaf:
                    # at the depth limit no split is searched when the whole chunk is there
                    seen_gain = 0.0 if gain is None or lvl >= max_depth[key[0]] else float(gain)
                    node.update(feature=-1, split_idx=-1, threshold=float("nan"),
                                left_categories=[], gain=seen_gain)
                    leaves.append(key)
                    continue
                f = int(b["feature"])
                cats = list(b["left_categories"] or [])
                sidx = int(b["split_idx"])
                node.update(feature=f, split_idx=sidx if arity[f] == 0 else -1,
                            threshold=float(splits.thresholds[f][sidx]) if arity[f] == 0
                            else float("nan"),
                            left_categories=[int(c) for c in cats] if arity[f] > 0 else [],
                            gain=float(gain))
                child_leaf = lvl + 1 >= max_depth[key[0]]
                for cid, cst in ((2 * key[1], lstats), (2 * key[1] + 1, rstats)):
                    ck = (key[0], cid)
                    row = root_row(key[0], C)
                    row.update(node_id=cid, stats=cst, impurity=impurity_py(kind, cst),
                               count=count_py(kind, cst), prediction=predict_py(kind, cst))
                    state.nodes[ck] = row
                    state.created.add(ck)
                    pure = row["impurity"] == 0.0
                    if params.store_leaf_stats or not (child_leaf or pure):
                        next_frontier.append(ck)
            for key in chunk:
                if key not in seen:  # no data reached the node in this batch
                    state.nodes[key]["is_leaf"] = True
            if leaf_sink and params.store_leaf_stats and leaves:
                lk = spark.createDataFrame(leaves, "tree_id int, node_id bigint")
                pending.append((hist, hist.join(F.broadcast(lk), Hg.NODE_KEY, "left_semi")))
            else:
                hist.unpersist()
        frontier = next_frontier
        first = False
    if pending:
        def finish():
            out = pending[0][1]
            for _, part in pending[1:]:
                out = out.unionByName(part)
            out.write.parquet(leaf_sink)  # a folder of this attempt alone
            for h, _ in pending:
                if h is not None:
                    h.unpersist()
        state.finish = finish  # run with the model's own writes
    return state
