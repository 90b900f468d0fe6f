"""Model inspection over the ``nodes`` table, M7-M9.  All are grouped
queries on a Spark DataFrame of nodes (one row per node)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def feature_importance(nodes: DataFrame) -> DataFrame:
    """M7: per tree, sum of gain x node count by split feature, normalised
    within the tree; summed over trees; normalised again."""
    per = (nodes.where(~F.col("is_leaf"))
           .groupBy("tree_id", "feature")
           .agg(F.sum(F.col("gain") * F.col("count")).alias("g")))
    norm = per.withColumn("g", F.col("g") / F.sum("g").over(Window.partitionBy("tree_id")))
    tot = norm.groupBy("feature").agg(F.sum("g").alias("g"))
    return tot.withColumn("importance", F.col("g") / F.sum("g").over(Window.partitionBy())) \
              .select("feature", "importance")


def tree_shape(nodes: DataFrame) -> DataFrame:
    """M8: node count, leaf count and depth per tree."""
    return nodes.groupBy("tree_id").agg(
        F.count(F.lit(1)).alias("num_nodes"),
        F.sum(F.col("is_leaf").cast("bigint")).alias("num_leaves"),
        F.max(F.floor(F.log2(F.col("node_id")))).cast("int").alias("depth"))


def forest_shape(nodes: DataFrame) -> DataFrame:
    """M8 totals: trees, nodes, deepest tree, highest split feature."""
    return nodes.agg(F.countDistinct("tree_id").alias("num_trees"),
                     F.count(F.lit(1)).alias("total_nodes"),
                     F.max(F.floor(F.log2(F.col("node_id")))).cast("int").alias("max_depth"),
                     F.max(F.when(~F.col("is_leaf"), F.col("feature"))).alias("max_split_feature"))


def tree_rules(nodes: DataFrame, names: Sequence[str] | None = None, style: str = "values") -> DataFrame:
    """M9: for every leaf the path from the root as text (``If``/``Else``
    conditions joined by 'and'; empty for a tree that is its root alone) and the
    leaf prediction.
    ``style='bins'`` writes ``f<feature> <= <split index>``; ``'values'``
    writes names and thresholds or category sets."""
    lvl = F.floor(F.log2(F.col("node_id"))).cast("int")
    leaves = nodes.where(F.col("is_leaf") & (lvl >= 1)).select(
        "tree_id", F.col("node_id").alias("leaf"), "prediction", lvl.alias("lvl"))
    anc = leaves.select("tree_id", "leaf", "prediction",
                        F.explode(F.sequence(F.lit(1), F.col("lvl"))).alias("k"))
    anc = (anc.withColumn("anc", F.expr("leaf >> k"))
           .withColumn("side", F.expr("(leaf >> (k - 1)) & 1")))
    n = nodes.select("tree_id", F.col("node_id").alias("anc"), "feature", "split_idx",
                     "threshold", "left_categories")
    j = anc.join(n, ["tree_id", "anc"])
    if style == "bins":
        cond = F.concat(F.lit("f"), F.col("feature").cast("string"),
                        F.when(F.col("side") == 0, F.lit(" <= ")).otherwise(F.lit(" > ")),
                        F.col("split_idx").cast("string"))
    else:
        fname = (F.element_at(F.array(*[F.lit(x) for x in names]), F.col("feature") + 1)
                 if names else F.concat(F.lit("feature "), F.col("feature").cast("string")))
        cats = F.concat(F.lit("{"), F.array_join(F.col("left_categories").cast("array<string>"), ","),
                        F.lit("}"))
        cont = F.concat(fname, F.when(F.col("side") == 0, F.lit(" <= ")).otherwise(F.lit(" > ")),
                        F.col("threshold").cast("string"))
        cat = F.concat(fname, F.when(F.col("side") == 0, F.lit(" in ")).otherwise(F.lit(" not in ")),
                       cats)
        cond = F.when(F.col("split_idx") >= 0, cont).otherwise(cat)
    rules = j.groupBy("tree_id", "leaf", "prediction").agg(
        F.sort_array(F.collect_list(F.struct(F.col("k"), cond.alias("c"))), asc=False).alias("p"))
    alone = nodes.where(F.col("is_leaf") & (lvl == 0)).select(
        "tree_id", "node_id", F.lit("").alias("rule"), "prediction")
    return rules.select("tree_id", F.col("leaf").alias("node_id"),
                        F.array_join(F.transform("p", lambda s: s["c"]), " and ").alias("rule"),
                        "prediction").unionByName(alone)
