"""The corpus pipeline: toxicity, line deduplication, near-duplicates, benchmark
decontamination and packing, each stage on what its predecessor kept.

A stage is (name, function); functions take (spark, docs, sf_dir).  All but the
last return the columns of ``documents`` (n_chars follows the text); ``run``
writes each result as Parquet under the shared work folder and rereads it.

Packing can't be expressed in SQL, so ``ORACLE_SQL`` is None and the tests hold
the pipeline against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.llm.common import fold, read, stored
from grove.session import ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    from grove.llm.toxicity import fit, score_documents
    ship_package(spark)
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold(F.col("doc_id")) != 0)
    scored = score_documents(docs, fit(docs, labels))
    return scored.where(F.col("predicted") == 0).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines repeated from an earlier one."""
    from grove.llm.linededup import dedup_lines
    ship_package(spark)
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each near-duplicate group."""
    from grove.llm.neardup import near_duplicates
    ship_package(spark)
    gone = near_duplicates(docs.select("doc_id", "text"), n=5, per_cent=80).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with the benchmark."""
    from grove.llm.decontam import decontaminate
    ship_package(spark)
    return decontaminate(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    import public_tokenizers

    from grove.llm.packing import pack_documents
    ship_package(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), words=450_000).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


ORACLE_SQL = None
