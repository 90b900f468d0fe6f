import numpy as np
import duckdb
from pyspark.sql import functions as F

from grove.functions import hashing as H


def test_three_backends_agree(spark):
    df = spark.range(0, 2000).select(
        "id", H.uniform(11, F.lit(4), F.col("id")).alias("u"),
        H.poisson_weight(H.uniform(11, F.lit(4), F.col("id"))).alias("p")).toPandas()
    u = H.uniform_np(11, np.int64(4), df.id.values)
    assert np.array_equal(u, df.u.values)
    assert np.array_equal(H.poisson_np(u), df.p.values)
    items = ", ".join(H.chain_select_items("h", 11, ["4", "id"]))
    r = duckdb.sql(f"SELECT id, {H.uniform_sql('h')} AS u, {H.poisson_sql(H.uniform_sql('h'))} AS p "
                   f"FROM (SELECT id, {items} FROM range(2000) t(id)) ORDER BY id").df()
    assert np.array_equal(r.u.values, u)
    assert np.array_equal(r.p.values, df.p.values)


def test_poisson_moments_and_independence():
    ids = np.arange(200_000)
    w0 = H.poisson_np(H.uniform_np(3, np.int64(0), ids))
    w1 = H.poisson_np(H.uniform_np(3, np.int64(1), ids))
    assert abs(w0.mean() - 1) < 0.01 and abs(w0.var() - 1) < 0.02
    assert abs(np.corrcoef(w0, w1)[0, 1]) < 0.01


def test_row_key_is_wide_and_deterministic(spark):
    df = spark.range(0, 5000).withColumn("k2", F.col("id") % 7)
    a = H.with_row_key(df, [F.col("id"), F.col("k2")]).select("rk").toPandas().rk
    b = H.with_row_key(df.repartition(3), [F.col("id"), F.col("k2")]).orderBy("id") \
        .select("rk").toPandas().rk
    assert a.is_unique and a.max() > 2 ** 40
    assert sorted(a) == sorted(b)
