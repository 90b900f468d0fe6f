"""Evaluation, S5 and E1-E9.

Binary curves follow the binned definition: distinct scores in descending
order; when there are more than ``num_bins`` of them, consecutive scores are
grouped ``count // num_bins`` at a time and a group is represented by its
highest score.  Ranks come from the distributed ranking helper, so no task
holds all scores; the per-bin table is bounded by about 2 x ``num_bins`` rows.
"""

from __future__ import annotations

import time
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grove.operators.prefix import running_sums

METRICS_SCHEMA = ("regrow double, incremental double, batch int, rows_seen bigint, "
                  "seconds double, error double")


# ---------------------------------------------------------------------- E1
def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Multiclass micro precision = accuracy; error = 1 - accuracy."""
    ok = (F.col(label).cast("double") == F.col(prediction).cast("double")).cast("double")
    return df.agg(F.round(F.avg(ok), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).cast("double").alias("label"),
                      F.col(prediction).cast("double").alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------- E6-E9
def score_bins(df: DataFrame, score: str = "score", label: str = "label",
               num_bins: int = 100) -> DataFrame:
    """(bin, threshold, pos, neg, cum_pos, cum_neg, total_pos, total_neg),
    bins in descending score order."""
    from pyspark import StorageLevel
    # one row per distinct score; read several times below (count, ranges,
    # ranks), so it is computed once - the scores upstream may be a model
    per = (df.groupBy(F.col(score).cast("double").alias("s"))
           .agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("bigint").alias("pos"),
                F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).cast("bigint").alias("neg"))
           .persist(StorageLevel.MEMORY_AND_DISK))
    ranked = running_sums(per, [], "s", [], descending=True)
    n_distinct = per.count()
    grouping = n_distinct // num_bins if num_bins > 0 else 0
    b = (F.floor((F.col("rank") - 1) / grouping) if grouping >= 2 else F.col("rank") - 1)
    bins = (ranked.withColumn("bin", b.cast("bigint")).groupBy("bin")
            .agg(F.max("s").alias("threshold"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # <= 2*num_bins rows
    wa = Window.partitionBy()
    return (bins.withColumn("cum_pos", F.sum("pos").over(w))
            .withColumn("cum_neg", F.sum("neg").over(w))
            .withColumn("total_pos", F.sum("pos").over(wa))
            .withColumn("total_neg", F.sum("neg").over(wa)))


def _share(a: str, b: Column) -> Column:
    """a / b, 0 where a class is absent and b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.col(a) / F.when(b != 0, b))


def roc_curve(bins: DataFrame) -> DataFrame:
    """(fpr, tpr) with (0,0) first and (1,1) last; ``point`` orders them."""
    spark = bins.sparkSession
    pts = bins.select((F.col("bin") + 1).alias("point"),
                      _share("cum_neg", F.col("total_neg")).alias("fpr"),
                      _share("cum_pos", F.col("total_pos")).alias("tpr"))
    last = bins.agg((F.max("bin") + 2).alias("point")).select(
        "point", F.lit(1.0).alias("fpr"), F.lit(1.0).alias("tpr"))
    first = spark.createDataFrame([(0, 0.0, 0.0)], "point bigint, fpr double, tpr double")
    return first.unionByName(pts).unionByName(last)


def auc(roc: DataFrame) -> DataFrame:
    """Trapezoid area under the ROC points."""
    w = Window.orderBy("point")  # bounded by the bin count
    seg = roc.withColumn("pf", F.lag("fpr").over(w)).withColumn("pt", F.lag("tpr").over(w))
    return seg.agg(F.sum((F.col("fpr") - F.col("pf")) * (F.col("tpr") + F.col("pt")) / 2.0)
                   .alias("auc"))


def pr_curve(bins: DataFrame) -> DataFrame:
    """(recall, precision) with (0, 1) first."""
    spark = bins.sparkSession
    pts = bins.select((F.col("bin") + 1).alias("point"),
                      _share("cum_pos", F.col("total_pos")).alias("recall"),
                      _share("cum_pos", F.col("cum_pos") + F.col("cum_neg")).alias("precision"))
    first = spark.createDataFrame([(0, 0.0, 1.0)], "point bigint, recall double, precision double")
    return first.unionByName(pts)


def metrics_by_threshold(bins: DataFrame, beta: float = 1.0) -> DataFrame:
    """Precision, recall and F-measure at each threshold."""
    p = _share("cum_pos", F.col("cum_pos") + F.col("cum_neg"))
    r = _share("cum_pos", F.col("total_pos"))
    b2 = beta * beta
    low = b2 * p + r
    f = F.when(low == 0, F.lit(0.0)).otherwise((1 + b2) * p * r / F.when(low != 0, low))
    return bins.select("threshold", p.alias("precision"), r.alias("recall"), f.alias("f_measure"))


# ------------------------------------------------------------------- E2-E5
def prequential(fit: Callable, update: Callable, score: Callable, batches: "DataFrame | BatchStore",
                batch_col: str = "batch", holdout: int | None = None,
                regrow: float = 0.0, incremental: float = 1.0) -> DataFrame:
    """Train on batch 0, then for each later batch i: evaluate the
    current model on batch i (prequential) or on the hold-out batch, then
    update with batch i.  Returns one metrics row per step (S5 shape).  The
    batches are stored apart once, so that a step reads its own files alone."""
    from grove.sources.batches import BatchStore
    store = batches if isinstance(batches, BatchStore) else BatchStore.write(batches, batch_col=batch_col)
    spark = store.spark
    ids = [b for b in store.ids() if b != holdout]
    rows = []
    seen = 0
    model = None
    for i, b in enumerate(ids):
        test_id = holdout if holdout is not None else (ids[i + 1] if i + 1 < len(ids) else None)
        if test_id is None:
            break  # nothing follows to test on, so no model is needed
        part = store.read(b)
        t = time.time()
        model = fit(part) if model is None else update(model, part)
        secs = time.time() - t
        seen = int(model.rows_seen)
        acc = accuracy(score(model, store.read(test_id))).first()["accuracy"]
        rows.append((float(regrow), float(incremental), int(b), seen, float(secs),
                     float(1.0 - (acc or 0.0))))
    return spark.createDataFrame(rows, METRICS_SCHEMA)


def policy_grid(step: float = 0.1) -> list[tuple[float, float]]:
    """All (regrow, incremental) on a grid with regrow + incremental <= 1."""
    n = int(round(1.0 / step))
    return [(round(r * step, 10), round(p * step, 10)) for r in range(n + 1)
            for p in range(n + 1) if r + p <= n]


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Append metrics rows to a Parquet table."""
    metrics.write.mode("append").parquet(path)
