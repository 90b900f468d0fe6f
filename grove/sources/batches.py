"""Numbered batches stored apart.

``BatchStore.write`` lays a table out once, a folder per batch number; a step over
batch i then opens the files of batch i alone, however many batches there are.
The rows are rebalanced by batch number first, so that large batches are split over
several files and small ones don't leave a file for every task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grove.session import new_work_path


class BatchStore:
    """Batches of one table below ``path``; ``schema`` leaves out the batch column."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, batch_col: str = "batch"):
        self.spark, self.path, self.schema, self.batch_col = spark, path, schema, batch_col

    @classmethod
    def write(cls, df: DataFrame, path: str | None = None, batch_col: str = "batch") -> "BatchStore":
        """Stores ``df`` by its batch column (integers; rows without a number are an error)."""
        spark = df.sparkSession
        path = path or new_work_path(spark, "batches")
        number = F.coalesce(F.col(batch_col).cast("int"),
                            F.raise_error(F.lit("a row has no batch number")).cast("int"))
        rest = [c for c in df.columns if c != batch_col]
        out = df.select(*rest, number.alias(batch_col))
        out.hint("rebalance", batch_col).write.mode("append").partitionBy(batch_col).parquet(path)
        return cls(spark, path, T.StructType([df.schema[c] for c in rest]), batch_col)

    def ids(self) -> list[int]:
        """Batch numbers, from the folder names."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        start = f"{self.batch_col}="
        return sorted(int(n[len(start):]) for n in names if n.startswith(start))

    def read(self, batch: int) -> DataFrame:
        """The rows of one batch, from its own folder; an absent one has none."""
        if batch not in self.ids():
            return self.spark.createDataFrame([], self.schema).withColumn(self.batch_col, F.lit(int(batch)))
        df = self.spark.read.schema(self.schema).parquet(f"{self.path}/{self.batch_col}={int(batch)}")
        return df.withColumn(self.batch_col, F.lit(int(batch)))

    def upto(self, batch: int) -> DataFrame:
        """The rows of all batches to ``batch``, in one scan of their folders."""
        folders = [f"{self.path}/{self.batch_col}={b}" for b in self.ids() if b <= batch]
        if not folders:
            return self.read(batch)
        return self.spark.read.schema(self.schema).parquet(*folders)
