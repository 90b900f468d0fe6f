"""Training fixtures on the supplied tables, each in two forms: a Spark
DataFrame builder and the same definition as DuckDB SQL (a CTE body) for
the oracle queries.  Every fixture carries ``rk``, a BIGINT hash of the
table's unique key, which drives all sampling.

hyperplane   lineitem; label l_quantity + 3*round(100 l_discount)
             + 2*round(100 l_tax) > 48; features quantity, discount, tax,
             extendedprice (the last carries no signal)
drift        hyperplane with the label inverted from 1998-06-01 on
events       events; label event_type = 'purchase'; batch = day
categorical  orders join customer; two indexed string features
regression   part; label p_retailprice
multiclass   embeddings; 64 features from the vector, label 0..9
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.functions import hashing as H
from grove.operators.features import FeatureSpec
from grove.sources.tables import read_table

HYPER_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
EVENT_FEATURES = ["value", "hour", "user_key"]
CAT_FEATURES = ["priority_idx", "segment_idx", "o_totalprice", "c_acctbal"]
REG_FEATURES = ["p_size", "brand_idx", "type_idx"]
EMB_DIM = 64
EMB_FEATURES = [f"e{i:02d}" for i in range(EMB_DIM)]

DRIFT_DATE = "1998-06-01"


def _key_sql(alias: str, seed: int, exprs: list[str]) -> str:
    return ", ".join(H.row_key_sql(alias, seed, exprs))


# --------------------------------------------------------------- hyperplane
LI_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
           "CAST(round(l_extendedprice * 100) AS BIGINT)"]
HYPER_LABEL_SQL = ("CASE WHEN l_quantity + 3 * round(l_discount * 100) + 2 * round(l_tax * 100) "
                   "> 48 THEN 1.0 ELSE 0.0 END")


def hyperplane(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    keys = [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint")]
    df = H.with_row_key(li, keys)
    label = F.when(F.col("l_quantity") + 3 * F.round(F.col("l_discount") * 100)
                   + 2 * F.round(F.col("l_tax") * 100) > 48, F.lit(1.0)).otherwise(F.lit(0.0))
    return df.select("rk", label.alias("label"), *HYPER_FEATURES, "l_shipdate")


def hyperplane_sql() -> str:
    return (f"SELECT rk, label, {', '.join(HYPER_FEATURES)}, l_shipdate FROM ("
            f"SELECT *, {_key_sql('rk', 0, LI_KEYS)}, {HYPER_LABEL_SQL} AS label FROM lineitem)")


def hyperplane_spec(num_classes: int = 2) -> FeatureSpec:
    return FeatureSpec(list(HYPER_FEATURES), [0] * 4, "label", num_classes)


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hyperplane(spark, sf_dir)
    late = F.col("l_shipdate") >= F.lit(DRIFT_DATE).cast("timestamp_ntz")
    return (h.withColumn("label", F.when(late, 1.0 - F.col("label")).otherwise(F.col("label")))
            .withColumn("batch", F.year("l_shipdate") * 12 + F.month("l_shipdate")))


def drift_sql() -> str:
    return (f"SELECT rk, CASE WHEN l_shipdate >= TIMESTAMP '{DRIFT_DATE}' THEN 1.0 - label "
            f"ELSE label END AS label, {', '.join(HYPER_FEATURES)}, l_shipdate, "
            f"year(l_shipdate) * 12 + month(l_shipdate) AS batch FROM ({hyperplane_sql()})")


# ------------------------------------------------------------------ events
def events(spark: SparkSession, sf_dir: str, day: int | None = None) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    if day is not None:
        e = e.where(day_range(day))
    df = H.with_row_key(e, [F.col("event_id")])
    return df.select(
        "rk", "event_id",
        F.when(F.col("event_type") == "purchase", F.lit(1.0)).otherwise(F.lit(0.0)).alias("label"),
        F.col("value").cast("double").alias("value"),
        F.hour("ts").cast("double").alias("hour"),
        F.col("user_id").cast("double").alias("user_key"),
        F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("day"),
        "event_type", "props")


def day_range(day: int):
    """Rows of one day as a range on the raw timestamp, so the filter reaches
    the parquet scan (row-group statistics) instead of a derived column."""
    import datetime as _dt
    start = _dt.datetime(1970, 1, 1) + _dt.timedelta(days=int(day))
    end = start + _dt.timedelta(days=1)
    ts = F.col("ts")
    return (ts >= F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz")) & \
        (ts < F.lit(end.isoformat(sep=" ")).cast("timestamp_ntz"))


def events_sql() -> str:
    return ("SELECT rk, event_id, CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END AS label, "
            "CAST(value AS DOUBLE) AS value, CAST(hour(ts) AS DOUBLE) AS hour, "
            "CAST(user_id AS DOUBLE) AS user_key, "
            "CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS day, "
            f"event_type, props FROM (SELECT *, {_key_sql('rk', 0, ['event_id'])} FROM events)")


def events_spec() -> FeatureSpec:
    return FeatureSpec(list(EVENT_FEATURES), [0] * 3, "label", 2)


# ------------------------------------------------------------- categorical
def _freq_index_sql(table: str, col: str) -> str:
    return (f"SELECT {col} AS v, CAST(row_number() OVER (ORDER BY count(*) DESC, {col}) - 1 "
            f"AS DOUBLE) AS idx FROM {table} GROUP BY {col}")


def categorical(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[int]]:
    from grove.operators.features import string_index
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    j, pi = string_index(j, "o_orderpriority", "priority_idx")
    j, si = string_index(j, "c_mktsegment", "segment_idx")
    j = H.with_row_key(j, [F.col("o_orderkey")])
    lab = F.when(F.col("o_orderstatus") == "F", F.lit(1.0)).otherwise(F.lit(0.0))
    return (j.select("rk", "o_orderkey", lab.alias("label"), *CAT_FEATURES),
            [len(pi.labels), len(si.labels), 0, 0])


def categorical_sql() -> str:
    return ("SELECT rk, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS label, "
            "p.idx AS priority_idx, s.idx AS segment_idx, o_totalprice, c_acctbal FROM ("
            f"SELECT *, {_key_sql('rk', 0, ['o_orderkey'])} FROM orders JOIN customer "
            "ON o_custkey = c_custkey) j "
            f"JOIN ({_freq_index_sql('orders', 'o_orderpriority')}) p ON j.o_orderpriority = p.v "
            "JOIN (SELECT c_mktsegment AS v, CAST(row_number() OVER (ORDER BY count(*) DESC, "
            "c_mktsegment) - 1 AS DOUBLE) AS idx FROM orders JOIN customer ON o_custkey = c_custkey "
            "GROUP BY c_mktsegment) s ON j.c_mktsegment = s.v")


# -------------------------------------------------------------- regression
def regression(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[int]]:
    from grove.operators.features import string_index
    p = read_table(spark, sf_dir, "part")
    p, bi = string_index(p, "p_brand", "brand_idx")
    p, ti = string_index(p, "p_type", "type_idx")
    p = H.with_row_key(p, [F.col("p_partkey")])
    return (p.select("rk", "p_partkey", F.col("p_retailprice").alias("label"),
                     F.col("p_size").cast("double").alias("p_size"), "brand_idx", "type_idx"),
            [0, len(bi.labels), len(ti.labels)])


def regression_sql() -> str:
    return ("SELECT rk, p_partkey, p_retailprice AS label, CAST(p_size AS DOUBLE) AS p_size, "
            "b.idx AS brand_idx, t.idx AS type_idx FROM ("
            f"SELECT *, {_key_sql('rk', 0, ['p_partkey'])} FROM part) j "
            f"JOIN ({_freq_index_sql('part', 'p_brand')}) b ON j.p_brand = b.v "
            f"JOIN ({_freq_index_sql('part', 'p_type')}) t ON j.p_type = t.v")


# -------------------------------------------------------------- multiclass
def multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    e = H.with_row_key(e, [F.col("vec_id")])
    return e.select("rk", "vec_id", F.col("label").cast("double").alias("label"),
                    *[F.element_at("embedding", i + 1).cast("double").alias(n)
                      for i, n in enumerate(EMB_FEATURES)])
