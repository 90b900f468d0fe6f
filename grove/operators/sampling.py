"""Sampling and batch making, B1-B5.

All draws are hashes of (seed, keys), never ``rand()``: a retried task or a
different partitioning produces the same sample, batch or bag weight.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grove.functions import hashing as H

# seeds per use, so that the draws of different uses are independent
SEED_BATCH = 101
SEED_SAMPLE = 202
SEED_BAG = 303
SEED_SUBSET = 404
SEED_FATE = 505
SEED_ERF = 606


# ----------------------------------------------------------------------- B1
def batch_of(key: Column, num_batches: int, holdout: bool = True, seed: int = 0) -> Column:
    """B1: batch id per row.  Weights 1.0 for each of ``num_batches`` and
    ``num_batches/4`` for a hold-out (id ``num_batches``), normalised like
    ``randomSplit``."""
    u = H.uniform(SEED_BATCH + seed, key)
    total = num_batches + (num_batches / 4.0 if holdout else 0.0)
    b = F.floor(u * F.lit(float(total))).cast("int")
    return F.least(b, F.lit(num_batches if holdout else num_batches - 1))


def split_batches(df: DataFrame, num_batches: int, key: str = "rk",
                  holdout: bool = True, seed: int = 0) -> DataFrame:
    return df.withColumn("batch", batch_of(F.col(key), num_batches, holdout, seed))


# ----------------------------------------------------------------------- B2
def quantile_fraction(max_bins: int, num_rows: int) -> float:
    """Share of rows the candidate-split search reads."""
    required = max(max_bins * max_bins, 10000)
    return 1.0 if required >= num_rows else required / float(num_rows)


def quantile_sample(df: DataFrame, fraction: float, key: str = "rk", seed: int = 0) -> DataFrame:
    """B2: Bernoulli sample without replacement by hash threshold."""
    if fraction >= 1.0:
        return df
    return df.where(H.uniform(SEED_SAMPLE + seed, F.col(key)) < F.lit(float(fraction)))


# ----------------------------------------------------------------------- B3
def bag_weights(df: DataFrame, num_trees: int, key: str = "rk", rate: float = 1.0,
                seed: int = 0, tree_offset: int = 0, keep: Sequence[str] = ()) -> DataFrame:
    """B3 in long form: one row (key, keep..., tree_id, weight) per row and
    tree.  The training path computes the same weights inside Arrow batches
    (``bag_weight_np``) and never materialises this product."""
    trees = F.explode(F.sequence(F.lit(tree_offset), F.lit(tree_offset + num_trees - 1)))
    out = df.select(F.col(key), *keep, trees.alias("tree_id"))
    u = H.uniform(SEED_BAG + seed, F.col("tree_id"), F.col(key))
    return out.withColumn("weight", H.bag_weight(u, num_trees, rate))


def bag_weights_np(keys: np.ndarray, tree_id: int, num_trees: int, rate: float = 1.0,
                   seed: int = 0) -> np.ndarray:
    u = H.uniform_np(SEED_BAG + seed, np.int64(tree_id), keys)
    return H.bag_weight_np(u, num_trees, rate)


# ----------------------------------------------------------------------- B4
def subset_size(strategy: str | float | int, num_features: int, num_trees: int,
                classification: bool = True) -> int:
    """Features considered per node."""
    s = strategy
    if isinstance(s, str):
        s = s.lower()
        if s == "auto":
            s = "all" if num_trees == 1 else ("sqrt" if classification else "onethird")
        if s == "all":
            return num_features
        if s == "sqrt":
            return max(1, int(math.ceil(math.sqrt(num_features))))
        if s == "log2":
            return max(1, int(math.ceil(math.log2(num_features)))) if num_features > 1 else 1
        if s == "onethird":
            return max(1, int(math.ceil(num_features / 3.0)))
        s = float(s)
    if isinstance(s, float) and s <= 1.0:
        return max(1, int(math.ceil(s * num_features)))
    return max(1, min(num_features, int(s)))


def feature_subsets(nodes: DataFrame, num_features: int, k: int, seed: int = 0,
                    version: int = 0) -> DataFrame:
    """For each (tree_id, node_id) the k features of smallest hash rank.
    Group size is the feature count, so the window is bounded."""
    f = F.explode(F.sequence(F.lit(0), F.lit(num_features - 1))).alias("feature")
    long = nodes.select("tree_id", "node_id", f)
    u = H.uniform(SEED_SUBSET + seed, F.lit(version), F.col("tree_id"), F.col("node_id"),
                  F.col("feature"))
    w = Window.partitionBy("tree_id", "node_id").orderBy(F.col("_u"), F.col("feature"))
    return (long.withColumn("_u", u).withColumn("_r", F.row_number().over(w))
            .where(F.col("_r") <= k).select("tree_id", "node_id", "feature"))


def feature_subset_mask_np(tree_ids: np.ndarray, node_ids: np.ndarray, num_features: int,
                           k: int, seed: int = 0, version: int = 0) -> np.ndarray:
    """Same subsets as ``feature_subsets`` as a boolean [node, feature] mask."""
    n = len(tree_ids)
    if k >= num_features:
        return np.ones((n, num_features), dtype=bool)
    feats = np.arange(num_features, dtype=np.int64)
    u = H.uniform_np(SEED_SUBSET + seed, np.int64(version), tree_ids[:, None],
                     node_ids[:, None], feats[None, :])
    order = np.lexsort((np.broadcast_to(feats, u.shape), u), axis=1)
    mask = np.zeros((n, num_features), dtype=bool)
    rows = np.repeat(np.arange(n), k)
    mask[rows, order[:, :k].ravel()] = True
    return mask


# ----------------------------------------------------------------------- B5
def union_batches(batches: Sequence[DataFrame]) -> DataFrame:
    """Cumulative training set."""
    return reduce(lambda a, b: a.unionByName(b), batches)
