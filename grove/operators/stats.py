"""Weighted column statistics, L1-L4.

The summary is kept as *moments* per column, which merge by plain sums and
min/max; that is what makes a stored summary mergeable with the summary of
a new batch (L2) and lets each task sum its own rows first.

moments: n (values in rows of weight > 0), w, w2, s1 = sum w (x - c),
         s2 = sum w (x - c)^2, q = sum w x^2, nnz = sum w [x != 0],
         l1 = sum w |x|, min, max
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grove.session import new_work_path

MOMENT_COLS = ["n", "w", "w2", "c", "s1", "s2", "q", "nnz", "l1", "vmin", "vmax"]
PARTIAL_COLS = [*MOMENT_COLS, "rows", "rows_w"]
SUMS = ["n", "w", "w2", "q", "nnz", "l1"]
MAX_HELD_GROUPS = 10_000  # groups a task holds before it hands them on


def _w(weight: str | None) -> Column:
    return F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)


def _partials(df: DataFrame, columns: Sequence[str], weight: str | None, group_by: Sequence[str]) -> DataFrame:
    """Moments of each partition's rows from one pass, a row per group and column.

    A batch's sums are taken of x minus the batch's mean and then moved to the
    shift the group already has, so that a large offset does not cancel."""
    w = _w(weight)
    base = df.where(w > 0) if weight else df
    inp = base.select(*group_by, w.alias("__w"), *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(columns)])
    schema = T.StructType([inp.schema[g] for g in group_by] + [T.StructField("feature", T.StringType())]
                          + [T.StructField(m, T.LongType() if m in ("n", "rows") else T.DoubleType()) for m in PARTIAL_COLS])
    groups, k = list(group_by), len(columns)

    def of_batch(rb: pa.RecordBatch) -> Iterator[tuple[tuple, dict]]:
        code, coded = np.zeros(rb.num_rows, np.int64), []
        for g in groups:
            d = rb.column(g).dictionary_encode()
            at = d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
            code = np.unique(code * (len(d.dictionary) + 1) + at, return_inverse=True)[1]
            coded.append((d.dictionary, at))
        _, first, code = np.unique(code, return_index=True, return_inverse=True)
        order = np.argsort(code, kind="stable")
        code = code[order]
        starts = np.searchsorted(code, np.arange(len(first)))
        wt = rb.column("__w").to_numpy(zero_copy_only=False)[order]
        out = {m: np.zeros((k, len(first))) for m in PARTIAL_COLS}
        out["rows"][:] = np.diff(np.append(starts, len(code)))
        out["rows_w"][:] = np.add.reduceat(wt, starts)
        for i in range(k):
            col = rb.column(f"__x{i}")
            x = col.to_numpy(zero_copy_only=False)[order]
            there = col.is_valid().to_numpy(zero_copy_only=False)[order]
            v, u = np.where(there, x, 0.0), np.where(there, wt, 0.0)
            total = np.add.reduceat(u, starts)
            mean = np.add.reduceat(u * v, starts) / np.where(total > 0, total, 1.0)
            c = np.where(np.isfinite(mean), mean, 0.0)
            d = v - c[code]
            for m, part in (("n", there), ("w", u), ("w2", u * u), ("s1", u * d), ("s2", u * d * d), ("q", u * v * v),
                            ("nnz", u * (v != 0)), ("l1", u * np.abs(v))):
                out[m][i] = np.add.reduceat(part.astype(np.float64), starts)
            out["c"][i] = c
            # NaN counts as the largest value
            out["vmin"][i] = np.fmin.reduceat(np.where(there, x, np.nan), starts)
            out["vmax"][i] = np.maximum.reduceat(np.where(there, x, -np.inf), starts)
        for j, f in enumerate(first):
            key = tuple(None if at[f] == len(values) else values[int(at[f])].as_py() for values, at in coded)
            yield key, {m: a[:, j] for m, a in out.items()}

    def merged(a: dict, b: dict) -> dict:
        c = np.where(a["n"] > 0, a["c"], b["c"])
        out = {m: a[m] + b[m] for m in SUMS + ["rows", "rows_w"]} | {
            "c": c, "vmin": np.fmin(a["vmin"], b["vmin"]), "vmax": np.maximum(a["vmax"], b["vmax"])}
        d = b["c"] - c
        out["s1"] = a["s1"] + b["s1"] + np.where(b["n"] > 0, d * b["w"], 0.0)
        out["s2"] = a["s2"] + b["s2"] + np.where(b["n"] > 0, 2 * d * b["s1"] + d * d * b["w"], 0.0)
        return out

    def emit(held: dict, types: list[pa.DataType]) -> pa.RecordBatch:
        cols = [pa.array([key[j] for key in held for _ in range(k)], t) for j, t in enumerate(types)]
        cols.append(pa.array(list(columns) * len(held), pa.string()))
        none = np.concatenate([a["n"] for a in held.values()]) == 0
        for m in PARTIAL_COLS:
            a = np.concatenate([a[m] for a in held.values()])
            whole = m in ("n", "rows")
            cols.append(pa.array(a.astype(np.int64) if whole else a, mask=None if whole or m in ("nnz", "rows_w") else none))
        return pa.RecordBatch.from_arrays(cols, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict] = {}
        types: list[pa.DataType] = []
        with np.errstate(invalid="ignore", over="ignore"):
            for rb in batches:
                if not rb.num_rows:
                    continue
                types = [rb.schema.field(g).type for g in groups]
                for key, part in of_batch(rb):
                    held[key] = merged(held[key], part) if key in held else part
                if len(held) > MAX_HELD_GROUPS:
                    yield emit(held, types)
                    held = {}
        if held:
            yield emit(held, types)

    return inp.mapInArrow(run, schema)


def _added(u: DataFrame, keys: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """Sums moments by ``keys`` after moving them to the smallest shift.  The
    window and the sums share one exchange, so the parts are read once."""
    low = F.min(F.when(F.col("n") > 0, F.col("c"))).over(Window.partitionBy(*keys))
    d = F.col("c") - F.col("_c")
    u = (u.withColumn("_c", F.coalesce(low, F.lit(0.0)))
         .withColumn("s2", F.col("s2") + 2 * d * F.col("s1") + d * d * F.col("w"))
         .withColumn("s1", F.col("s1") + d * F.col("w")).withColumn("c", F.col("_c")))
    how = {"c": F.min, "vmin": F.min, "vmax": F.max}
    return u.groupBy(*keys).agg(*[how.get(m, F.sum)(m).alias(m) for m in [*MOMENT_COLS, *more]])


def moments(df: DataFrame, columns: Sequence[str], weight: str | None = None,
            group_by: Sequence[str] = ()) -> DataFrame:
    """(group..., feature, moments..., rows, rows_w) from one scan: each partition's
    moments, then their sums.  Zero-weight rows are skipped; ``c`` is the shift
    of s1 and s2.  Without groups an empty table gives a row of nothing per column."""
    columns = list(dict.fromkeys(columns))
    parts = _partials(df, columns, weight, group_by)
    if not group_by:
        empty = df.sparkSession.createDataFrame([(c, 0, 0) for c in columns], "feature string, n long, rows long")
        parts = parts.unionByName(empty, allowMissingColumns=True)
    return _added(parts, [*group_by, "feature"], ["rows", "rows_w"])


def merge_moments(*parts: DataFrame, group_by: Sequence[str] = ("feature",)) -> DataFrame:
    """L2: exact merge of stored and new moments.  Parts with different shifts
    are moved to the smallest one first."""
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return _added(u, group_by)


def summary_from_moments(m: DataFrame, keep: Sequence[str] = ("feature",)) -> DataFrame:
    """L1 statistics: count, mean, unbiased weighted variance
    (sum w (x-mean)^2 / (W - W2/W), 0 when the denominator is not positive),
    min, max, weighted non-zeros, L1 and L2 norms."""
    mean = F.col("c") + F.col("s1") / F.col("w")
    denom = F.col("w") - F.col("w2") / F.col("w")
    var = F.when(denom > 0, (F.col("s2") - F.col("s1") * F.col("s1") / F.col("w")) / denom
                 ).otherwise(F.lit(0.0))
    return m.select(*keep, F.col("n").cast("bigint").alias("count"), mean.alias("mean"),
                    F.greatest(var, F.lit(0.0)).alias("variance"),
                    F.col("vmin").alias("min"), F.col("vmax").alias("max"),
                    F.col("nnz").alias("num_nonzeros"), F.col("l1").alias("norm_l1"),
                    F.sqrt(F.col("q")).alias("norm_l2"))


def column_summary(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """L1: one row per column."""
    return summary_from_moments(moments(df, columns, weight))


def label_histogram(df: DataFrame, label: str = "label", weight: str | None = None) -> DataFrame:
    """L3: weight and row count per label value, with a validity flag
    (negative or fractional labels are invalid)."""
    w = _w(weight)
    y = F.col(label).cast("double")
    return (df.groupBy(y.alias("label"))
            .agg(F.sum(w).alias("weight"), F.count(F.lit(1)).alias("n"))
            .withColumn("valid", (F.col("label") >= 0) & (F.col("label") == F.floor("label"))))


def check_labels(hist_rows, num_classes: int | None = None) -> int:
    """Raises on invalid labels; returns the class count (max label + 1)."""
    bad = [r for r in hist_rows if not r["valid"]]
    if bad:
        raise ValueError(f"{sum(r['n'] for r in bad)} invalid labels (negative or fractional)")
    k = int(max((r["label"] for r in hist_rows), default=-1)) + 1
    if num_classes is not None and k > num_classes:
        raise ValueError(f"label {k - 1} outside [0, {num_classes})")
    return max(k, num_classes or 0)


def joint_summary(df: DataFrame, columns: Sequence[str], label: str = "label",
                  weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """L4: feature moments and the label histogram from one scan: moments
    grouped by label, written once (a row per label and column), then merged
    over labels for the one and counted for the other."""
    per_label = moments(df.withColumn("_y", F.col(label).cast("double")), columns, weight,
                        group_by=["_y"])
    path = new_work_path(df.sparkSession, "joint-summary")
    per_label.write.parquet(path)
    per_label = df.sparkSession.read.schema(per_label.schema).parquet(path)
    feats = summary_from_moments(merge_moments(per_label.drop("_y")))
    labels = (per_label.where(F.col("feature") == columns[0])
              .select(F.col("_y").alias("label"), F.col("rows_w").alias("weight"),
                      F.col("rows").alias("n"))
              .withColumn("valid", (F.col("label") >= 0) & (F.col("label") == F.floor("label"))))
    return feats, labels
