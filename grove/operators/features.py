"""Preparation operators P1-P14: casts, parsing, indexing, one-hot, feature
selection, assembly, binning.

Everything is a Column expression over the input, so Catalyst can prune
columns and push filters into the scan; no row-at-a-time Python UDF.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grove.session import new_work_path


@dataclass
class FeatureSpec:
    """What a forest needs to know about its input table."""

    names: list[str]
    arity: list[int] = field(default_factory=list)  # 0 = continuous, k = k categories
    label: str = "label"
    num_classes: int = 2  # 0 = regression
    weight: str | None = None
    key: str = "rk"  # BIGINT row key (hash of data keys) driving all sampling

    def __post_init__(self):
        if not self.arity:
            self.arity = [0] * len(self.names)
        if len(self.arity) != len(self.names):
            raise ValueError("arity must have one entry per feature")

    @property
    def num_features(self) -> int:
        return len(self.names)

    def is_categorical(self, f: int) -> bool:
        return self.arity[f] > 0


# ------------------------------------------------------------------- P1, P2
def cast_int_column(df: DataFrame, column: str) -> DataFrame:
    """One integer column to double."""
    return df.withColumn(column, F.col(column).cast("double"))


def cast_int_columns(df: DataFrame) -> DataFrame:
    """Every IntegerType column to double, in one projection."""
    cols = [F.col(f.name).cast("double").alias(f.name)
            if isinstance(f.dataType, T.IntegerType) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


# ----------------------------------------------------------------------- P3
def parse_string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> DataFrame:
    """Every string column not excluded is parsed as a number; the empty
    string reads as 0.  Junk raises (ANSI cast)."""
    skip = set(exclude)
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType) and f.name not in skip:
            c = F.col(f.name)
            cols.append(F.when(c == "", F.lit("0")).otherwise(c).cast("double").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# ------------------------------------------------------------------- P4, P5
@dataclass
class StringIndex:
    """Frequency-ordered label index (most frequent = 0, ties by value) as a
    stored table (v, idx), so that it may hold any number of labels."""

    column: str
    table: DataFrame

    @cached_property
    def labels(self) -> list[str]:
        """The labels in order, for uses whose width is their number (one-hot)."""
        return [r["v"] for r in self.table.orderBy("idx").collect()]

    def apply(self, df: DataFrame, out: str, handle_invalid: str = "error") -> DataFrame:
        """Adds the index by a join with the label table (Spark broadcasts it while
        it is small).  Unseen labels raise, are skipped or get the next index."""
        t = self.table.select(F.col("v").alias("_v"), F.col("idx").cast("double").alias(out))
        res = df.join(t, F.col(self.column).cast("string") == F.col("_v"), "left").drop("_v")
        if handle_invalid == "skip":
            return res.where(F.col(out).isNotNull())
        if handle_invalid == "keep":
            return res.withColumn(out, F.coalesce(out, F.lit(float(self.table.count()))))
        raised = F.raise_error(F.concat(F.lit(f"unseen label in {self.column}: "),
                                        F.coalesce(F.col(self.column).cast("string"), F.lit("null"))))
        return res.withColumn(out, F.when(F.col(out).isNull(), raised.cast("double")).otherwise(F.col(out)))


def fit_string_index(df: DataFrame, column: str) -> StringIndex:
    """P4 fit: label frequencies are counted and sorted on executors; a label's
    index is its place in its sorted partition plus the sizes of those before."""
    spark = df.sparkSession
    counts = (df.groupBy(F.col(column).cast("string").alias("v")).count()
              .where(F.col("v").isNotNull()))
    path = new_work_path(spark, "labels")
    (counts.orderBy(F.desc("count"), F.asc("v")).withColumn("at", F.monotonically_increasing_id())
     .write.parquet(path))
    rows = spark.read.schema("v string, count bigint, at bigint").parquet(path)
    part = F.shiftright("at", 33)
    sizes = sorted(rows.groupBy(part.alias("p")).count().collect())  # one row per partition
    starts, total = {}, 0
    for p, n in sizes:
        starts[p], total = total, total + n
    start = F.lit(0)
    if starts:
        start = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), part)
    idx = start + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return StringIndex(column, rows.select("v", idx.cast("bigint").alias("idx")))


def string_index(df: DataFrame, column: str, out: str | None = None,
                 index: StringIndex | None = None, handle_invalid: str = "error"):
    """Adds ``out`` (double index).  Returns (DataFrame, StringIndex)."""
    index = index or fit_string_index(df, column)
    return index.apply(df, out or f"{column}_idx", handle_invalid), index


def one_hot_array(index_col: str, size: int, drop_last: bool = True) -> Column:
    """P5: index -> one-hot array<double>, last category dropped by default
    (all zeros), as the built-in encoder."""
    width = size - 1 if drop_last else size
    idx = F.col(index_col)
    return F.array(*[F.when(idx == F.lit(float(i)), F.lit(1.0)).otherwise(F.lit(0.0))
                     for i in range(width)]) if width > 0 else F.array().cast("array<double>")


def one_hot_columns(df: DataFrame, index_col: str, size: int, prefix: str,
                    drop_last: bool = True) -> DataFrame:
    """P5 in scalar form: one double column per kept category."""
    width = size - 1 if drop_last else size
    idx = F.col(index_col)
    return df.select("*", *[F.when(idx == F.lit(float(i)), F.lit(1.0)).otherwise(F.lit(0.0))
                            .alias(f"{prefix}_{i}") for i in range(width)])


def index_and_one_hot(df: DataFrame, columns: Sequence[str],
                      indexes: dict[str, StringIndex] | None = None):
    """Index then one-hot each string column.  ``indexes`` fitted on the
    first batch are reused for later batches (decision D9)."""
    indexes = dict(indexes or {})
    for c in columns:
        df, idx = string_index(df, c, f"{c}_idx", indexes.get(c))
        indexes[c] = idx
        df = df.withColumn(f"{c}_vec", one_hot_array(f"{c}_idx", len(idx.labels)))
    return df, indexes


# ----------------------------------------------------------------------- P7
def binarize(df: DataFrame, column: str, threshold: float, out: str) -> DataFrame:
    """``column > threshold`` -> 1.0 else 0.0."""
    return df.withColumn(out, F.when(F.col(column) > F.lit(float(threshold)), F.lit(1.0))
                         .otherwise(F.lit(0.0)))


# ------------------------------------------------------------------- P8, P9
def numeric_feature_columns(df: DataFrame, label: str, exclude: Iterable[str] = (),
                            min_name_len: int = 4) -> list[str]:
    """Double columns that are not the label, not excluded, and whose
    name has at least ``min_name_len`` characters."""
    skip = set(exclude) | {label}
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.DoubleType) and f.name not in skip
            and len(f.name) >= min_name_len]


def string_columns(df: DataFrame, names: Iterable[str] | None = None) -> list[str]:
    """String columns, optionally restricted to ``names``."""
    want = set(names) if names is not None else None
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)
            and (want is None or f.name in want)]


# ---------------------------------------------------------------- P10, P12
def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """P10: feature columns -> ``array<double>`` (vectors only at the edge,
    see ``to_vector``)."""
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in columns]))


def to_vector(df: DataFrame, column: str = "features") -> DataFrame:
    """Edge conversion to an ML vector for built-in estimators."""
    from pyspark.ml.functions import array_to_vector
    return df.withColumn(column, array_to_vector(F.col(column)))


def instances(df: DataFrame, label: str, features: str = "features",
              weight: str | None = None) -> DataFrame:
    """(label, weight, features); weight 1.0 when absent or null."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    return df.select(F.col(label).cast("double").alias("label"), w.alias("weight"),
                     F.col(features).alias("features"))


# ---------------------------------------------------------------- P13, P14
def bin_continuous(value: Column, thresholds: Sequence[float]) -> Column:
    """bin = number of thresholds strictly below the value, i.e. the
    index of the first threshold >= value; intervals (t[i-1], t[i]].
    NaN and null go to the last bin (right of every split)."""
    if not thresholds:
        return F.lit(0)
    ts = sorted(float(t) for t in thresholds)
    lit = F.array(*[F.lit(t) for t in ts])
    b = F.size(F.filter(lit, lambda t: t < value))
    return F.when(value.isNull() | F.isnan(value), F.lit(len(ts))).otherwise(b)


def bin_categorical(value: Column, arity: int, name: str = "feature") -> Column:
    """bin = category value; error when outside [0, arity)."""
    v = value.cast("int")
    ok = value.isNotNull() & (value >= 0) & (value < arity) & (value == v.cast("double"))
    return F.when(ok, v).otherwise(
        F.raise_error(F.lit(f"{name}: category outside [0, {arity})")).cast("int"))
