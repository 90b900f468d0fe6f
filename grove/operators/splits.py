"""Candidate splits, Q1-Q6.

Continuous features: if a feature has at most ``num_splits`` distinct
values, every distinct value is a threshold (Q2).  Otherwise the
equal-frequency stride walk (Q3): walking the sorted value counts, the
previous value becomes a threshold when adding the current value's count
moves the running count further from the current target; the target then
advances by ``stride = N / (num_splits + 1)``.

That walk is sequential, but it has a closed form.  With cumulative counts
C_j and midpoints mid_j = (C_{j-1} + C_j) / 2 (steps j = 2..m), emission k
happens at step j_k = k + max_{i<=k} (f(i) - i), where f(i) is the first
step whose midpoint exceeds i * stride; the emitted threshold is value
j_k - 1.  Comparisons are made in integers, mid_j * (S+1) > k * N, so no
floating-point target drifts.  The plan is: value counts (shuffle by
feature, value), distributed ranks (``prefix.running_sums``), then windows
over at most ``num_splits`` rows per feature.

Categorical features: unordered candidates (multiclass, small arity) are
the subsets given by the set bits of split_idx + 1 (Q5); ordered ones need
no candidates (their order is found per node at training time).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grove.operators.prefix import running_sums


# ----------------------------------------------------------------------- Q1
def long_values(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, v) long form of the listed columns; null/NaN skipped."""
    structs = [F.struct(F.lit(i).alias("feature"), F.col(c).cast("double").alias("v"))
               for i, c in enumerate(features)]
    return (df.select(F.explode(F.array(*structs)).alias("_s")).select("_s.*")
            .where(F.col("v").isNotNull() & ~F.isnan("v")))


def value_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Q1: (feature, v, n) - count of each distinct value of each feature."""
    return (long_values(df, features).groupBy("feature", "v")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n")))


# ------------------------------------------------------------------- Q2, Q3
def continuous_thresholds(vc: DataFrame, num_splits: int, range_rows: int | None = None) -> DataFrame:
    """Q2 + Q3 over value counts ``(feature, v, n)`` ->
    ``(feature, split_idx, threshold)``.  ``vc`` is read three times
    (count, range bounds, ranks): persist it when it is expensive."""
    S = int(num_splits)
    from pyspark import StorageLevel
    ranked = running_sums(vc, ["feature"], "v", ["n"], totals=True, range_rows=range_rows)
    # read three times below (all-values branch, stride steps, threshold
    # lookup): ranked once, kept (spillable) instead of re-sorted each time
    ranked = ranked.withColumnsRenamed({"tot_n": "n_total", "tot_rows": "m"}) \
        .persist(StorageLevel.MEMORY_AND_DISK)

    # Q2: few distinct values -> all of them
    few = (ranked.where(F.col("m") <= S)
           .select("feature", (F.col("rank") - 1).cast("int").alias("split_idx"),
                   F.col("v").alias("threshold")))

    # Q3: stride walk in closed form
    many = ranked.where(F.col("m") > S)
    x = (F.col("cum_n") * 2 - F.col("n")) * F.lit(S + 1)  # 2*mid_j*(S+1), integer
    steps = (many.where(F.col("rank") >= 2).withColumn("_x", x.cast("bigint"))
             # g = number of k >= 1 with k * stride < mid_j, in integer division
             .withColumn("g", F.expr("(_x - 1) div (n_total * 2)")).where(F.col("g") >= 1)
             .groupBy("feature", "g").agg(F.min("rank").alias("jf"),
                                          F.first("m").alias("m")))  # <= S rows/feature
    wg = Window.partitionBy("feature").orderBy("g")
    ks = (steps.withColumn("g0", F.coalesce(F.lag("g").over(wg), F.lit(0)))
          .select("feature", "m", "jf",
                  F.explode(F.sequence(F.col("g0") + 1, F.col("g"))).alias("k")))
    wk = Window.partitionBy("feature").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    emit = (ks.withColumn("jk", F.col("k") + F.max(F.col("jf") - F.col("k")).over(wk))
            .where(F.col("jk") <= F.col("m"))
            .select("feature", (F.col("k") - 1).cast("int").alias("split_idx"),
                    (F.col("jk") - 1).alias("rank")))
    stride = (emit.join(ranked.select("feature", "rank", F.col("v").alias("threshold")),
                        ["feature", "rank"])
              .select("feature", "split_idx", "threshold"))
    return few.unionByName(stride)


def thresholds_np(values: np.ndarray, counts: np.ndarray, num_splits: int) -> np.ndarray:
    """The same closed form over one feature's sorted distinct values and
    their counts (used on the bounded quantile sample)."""
    S = int(num_splits)
    m = len(values)
    if m <= S:
        return values.astype(np.float64)
    N = int(counts.sum())
    c = np.cumsum(counts.astype(np.int64))
    x = (2 * c - counts) * (S + 1)          # 2 * mid_j * (S+1), j = 1..m
    g = (x[1:] - 1) // (2 * N)              # steps j = 2..m (index 0 -> j = 2)
    ks = np.arange(1, S + 1)
    pos = np.searchsorted(g, ks, side="left")  # first step with g >= k
    ok = pos < len(g)
    ks, f = ks[ok], pos[ok] + 2             # f(k) as a 1-based step number
    jk = ks + np.maximum.accumulate(f - ks)
    jk = jk[jk <= m]
    return values[jk - 2].astype(np.float64)


# ----------------------------------------------------------------------- Q5
def max_unordered_arity(max_bins: int) -> int:
    return int(math.floor(math.log2(max(max_bins - 1, 1)))) + 1


def is_unordered(arity: int, num_classes: int, max_bins: int) -> bool:
    return num_classes > 2 and 0 < arity <= max_unordered_arity(max_bins)


def unordered_subsets(arity_df: DataFrame) -> DataFrame:
    """Q5: for rows ``(feature, arity)`` the candidate left sets: split_idx
    i has left categories = set bits of i + 1 (2^(arity-1) - 1 splits).
    Returns (feature, split_idx, left_mask bigint, categories string)."""
    n = F.pow(F.lit(2), F.col("arity") - 1).cast("bigint") - 1
    s = arity_df.select("feature", "arity", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
                        .alias("split_idx"))
    mask = F.col("split_idx") + 1
    cats = F.expr("filter(sequence(0, arity - 1), c -> ((split_idx + 1) >> c) & 1 = 1)")
    return s.select("feature", F.col("split_idx").cast("int").alias("split_idx"),
                    mask.alias("left_mask"),
                    F.array_join(cats, ",").alias("categories"))


# ----------------------------------------------------------------------- Q6
@dataclass
class Splits:
    """Frozen candidate splits of a model (I6): thresholds of continuous
    features; bins per feature.  Bounded by features x max_bins."""

    thresholds: list[np.ndarray]  # per feature; empty for categorical
    num_bins: list[int]
    unordered: list[bool]

    def to_rows(self):
        return [(f, i, float(t)) for f, ts in enumerate(self.thresholds) for i, t in enumerate(ts)]


def find_splits(sample: DataFrame, names: Sequence[str], arity: Sequence[int],
                num_classes: int, max_bins: int, on_constant: str = "ignore") -> tuple[Splits, DataFrame]:
    """Q6: all features in one grouped job.  ``sample`` is the (B2) sample: its
    rows are bounded by the bins, so a feature's value counts are a bounded group,
    and the closed form runs on each by itself, however many features there are.
    Returns the frozen ``Splits`` and the splits table."""
    cont = [i for i, a in enumerate(arity) if a == 0]
    S = max_bins - 1
    if cont:
        def walk(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("v")
            t = thresholds_np(g["v"].to_numpy(), g["n"].to_numpy(), S)
            return pd.DataFrame({"feature": np.full(len(t), cont[int(g["feature"].iloc[0])], np.int32),
                                 "split_idx": np.arange(len(t), dtype=np.int32), "threshold": t})

        tab = value_counts(sample, [names[i] for i in cont]).groupBy("feature").applyInPandas(
            walk, "feature int, split_idx int, threshold double")
        rows = tab.collect()  # bounded: features x (max_bins - 1)
    else:
        tab = None
        rows = []
    th: list[list[float]] = [[] for _ in names]
    for r in sorted(rows, key=lambda r: (r["feature"], r["split_idx"])):
        th[r["feature"]].append(float(r["threshold"]))
    num_bins, unordered = [], []
    for i, a in enumerate(arity):
        if a == 0:
            if not th[i] and on_constant == "error":
                raise ValueError(f"feature {names[i]} has no candidate split")
            num_bins.append(len(th[i]) + 1)
            unordered.append(False)
        else:
            num_bins.append(int(a))
            unordered.append(is_unordered(int(a), num_classes, max_bins))
    spl = Splits([np.asarray(t, dtype=np.float64) for t in th], num_bins, unordered)
    return spl, tab


def bins_np(values: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P13 vectorised: index of the first threshold >= value; NaN -> last."""
    b = np.searchsorted(thresholds, values, side="left")
    return np.where(np.isnan(values), len(thresholds), b)
