"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm.common import stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step: every node points its larger (small star: its smaller or equal)
    neighbours to the least node it knows.  Minima are combined before the shuffle;
    a hub's edges meet its single minimum in a join that can be split."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    joined = both.join(least, "a")
    moved = joined.where(F.col("b") != F.col("m") if small else F.col("b") > F.col("a"))
    out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if small:
        out = out.unionByName(least.where(F.col("m") < F.col("a")).select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(h, F.lit(1 << 31)))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b: long), component being
    the least id reachable.  Each step is stored, so that lineage stays short."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b"))
    edges = stored(edges.distinct(), "edges")
    mark = _mark(edges)
    while True:
        edges = stored(_star(_star(edges, small=False), small=True), "edges")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("b").alias("id")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component")))
