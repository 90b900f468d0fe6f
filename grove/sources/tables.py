"""Table sources.

* ``read_table``      - one supplied parquet table, spread once over the
                        cluster by a key (the test files hold one row group).
* ``read_csv``        - S1: header row, inferred schema (as the benchmarks did).
* ``read_numbered``   - S2: one file per batch (``3_processed.csv``,
                        ``bikeshare12.csv`` ...); the batch number comes from
                        the file name in ``_metadata``, so all batches are one
                        DataFrame and one scan instead of a driver loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.session import default_parallelism

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str,
               spread_by: list[str] | None = None,
               partitions: int | None = None) -> DataFrame:
    """Reads one supplied table.  ``spread_by`` hash-partitions the rows by
    key once after the scan: a file of one row group is otherwise read by a
    single task, and every later stage would inherit that."""
    df = spark.read.parquet(table_path(sf_dir, name))
    if spread_by:
        n = partitions or default_parallelism(spark)
        df = df.repartition(n, *[F.col(c) for c in spread_by])
    return df


def read_csv(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """CSV with a header row; types inferred (two scans) unless disabled."""
    return (spark.read.option("header", True)
            .option("inferSchema", bool(infer))
            .csv(path))


def read_numbered(spark: SparkSession, pattern: str, fmt: str = "csv",
                  number_regex: str = r"(\d+)", batch_col: str = "batch",
                  from_path: bool = False, **options) -> DataFrame:
    """Numbered batch files as one DataFrame with a ``batch`` column.

    ``pattern`` is a glob (``/data/*_processed.csv``); ``number_regex``'s
    first group, applied to the file name, is the batch number."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", True)
    for k, v in options.items():
        reader = reader.option(k, v)
    df = reader.load(pattern)
    src = F.col("_metadata.file_path") if from_path else F.col("_metadata.file_name")
    return df.withColumn(batch_col, F.regexp_extract(src, number_regex, 1).cast("int"))
