"""Mixing sources to target weights by entropy balancing.

Every document gets a rate of at most ``most``; the rates stay as close to 1 (in
relative entropy) as the constraint allows that each source's tokens, counted with
their rates, come to the source's target.  The optimum tilts exponentially: with z
the document's size over its source's mean, the rate is min(most, exp(lam * z)).
lam is the root of the derivative of a convex dual, g(lam) = sum of z * rate - target;
Newton steps find it, kept inside the bracket that earlier signs of g left (a step
that leaves it is replaced by the bracket's middle).

All documents of a source with one size have one rate, so everything after the
first pass works on (source, size, count) rows: a Newton step is one aggregation
over them, for all sources at once, in exact decimals so that the order of
partitions does not show in the result.

Rates become whole copies by carrying the error in tokens from the largest size of
a source down to the smallest: each size takes the number of copies nearest to what
is due, so a source ends a few words from its target: half the smallest size whose
copies had room, between none and ``most`` a document.
Which documents of a size get the odd copies is drawn by hash: a size with n
documents is dealt into about sqrt(n) parts, each with its share of odd copies, and
only inside a part are documents ranked, so a hot size never meets in one task.

Targets: sources in code point order (null last) weigh ``weights``, repeating; lam
times weight, but at most ``most`` times the source's tokens, with the level lam
raised until all tokens are shared out (a few aggregations over sources).

Defined results: a null text has size 0; documents of size 0 are taken once (no
words); sources without words have target 0; a null source is a source of its own;
rows of one doc_id are documents of their own, and rows that are equal in id, source
and text are interchangeable; an empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grove.llm.common import stored

KEY = ["none", "source"]  # a null source: (true, '')
STEPS = 200
NEAR = 1e-10  # share of the target that a Newton solution may miss


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, none, source, size, h) of every row."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").isNull().alias("none"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("doc_id", "text").alias("h"))


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``rank`` (from 0) in the order of columns that identify a row.  Ranges
    are ranked apart; the offsets are one number for each partition."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "mix-ranges")
    before, rows = 0, []
    for r in sorted(placed.groupBy("part").count().collect()):
        rows.append((r["part"], before))
        before += r["count"]
    offsets = spark.createDataFrame(rows, "part int, before long")
    w = Window.partitionBy("part").orderBy(*order)
    return placed.withColumn("rank", F.row_number().over(w) - 1).join(F.broadcast(offsets), "part").withColumn(
        "rank", F.col("rank") + F.col("before")).drop("part", "before")


def targets(rows: DataFrame, weights: tuple = (5, 2, 1), most: int = 3) -> DataFrame:
    """(none, source, source_size, docs, target) from sized rows."""
    per = rows.groupBy(*KEY).agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("docs"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = stored(ranked(per, KEY).withColumn("weight", weight).drop("rank"), "mix-sources")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:  # raise the level by what full sources can't take
        full = F.col("source_size") * most <= F.col("weight") * level
        r = per.agg(F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("held"),
                    F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if not r["open"] or (total - most * r["held"]) / r["open"] <= level:
            break
        level = (total - most * r["held"]) / r["open"]
    target = F.least(F.col("source_size") * float(most), F.col("weight") * level)
    return per.withColumn("target", target).drop("weight")


def solve(classes: DataFrame, sources: DataFrame, most: int = 3) -> DataFrame:
    """(none, source, lam): the dual solution of each source with a target below
    ``most`` times its tokens; ``classes`` has (none, source, size, n)."""
    cap = math.log(most)
    duals = stored(sources.where((F.col("source_size") > 0) & (F.col("target") < F.col("source_size") * (most * (1 - 1e-12)))).select(
        *KEY, (F.col("source_size") / F.col("docs")).alias("mean"), (F.col("target") * F.col("docs") / F.col("source_size")).alias("due"),
        F.lit(0.0).alias("lam"), F.lit(-math.inf).alias("lo"), F.lit(math.inf).alias("hi"), F.lit(False).alias("done")), "mix-duals")
    part = classes.where(F.col("size") > 0)
    for _ in range(STEPS):
        z = F.col("size") / F.col("mean")
        tilt = F.col("lam") * z
        held = tilt >= cap
        each = F.col("n") * z * F.when(held, float(most)).otherwise(F.exp(F.least(tilt, F.lit(cap))))
        sums = part.join(duals.where(~F.col("done")).select(*KEY, "mean", "lam"), KEY).groupBy(*KEY).agg(
            F.sum(each.cast("decimal(30,12)")).cast("double").alias("got"),
            F.sum(F.when(held, 0.0).otherwise(each * z).cast("decimal(30,12)")).cast("double").alias("slope"))
        g = F.col("got") - F.col("due")
        near = F.abs(g) <= F.col("due") * NEAR
        lo = F.when(g < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(g > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - g / F.when(F.col("slope") > 0, F.col("slope"))
        new = F.when((step > lo) & (step < hi), step).otherwise((lo + hi) / 2)
        new = F.when(near | (new == F.col("lam")), F.col("lam")).otherwise(new)
        before = duals.where(F.col("done"))
        now = duals.where(~F.col("done")).join(sums, KEY).select(
            *KEY, "mean", "due", new.alias("lam"), lo.alias("lo"), hi.alias("hi"), (near | (new == F.col("lam"))).alias("done"))
        duals = stored(before.unionByName(now), "mix-duals")
        if not duals.where(~F.col("done")).take(1):
            return duals.select(*KEY, "lam")
    raise RuntimeError(f"entropy balancing did not settle in {STEPS} steps")


def copies_of_sizes(size: list[int], n: list[int], rate: list[float], most: int) -> list[int]:
    """Copies that all documents of each size get together: from the largest size
    down, the number nearest to what its documents and the carried tokens are due."""
    out, carry = [0] * len(size), 0.0
    for i in sorted(range(len(size)), key=lambda i: -size[i]):
        if size[i] == 0:
            out[i] = n[i]
            continue
        due = n[i] * rate[i] * size[i] + carry
        out[i] = min(max(math.floor(due / size[i] + 0.5), 0), most * n[i])
        carry = due - out[i] * size[i]
    return out


def rounded(rates: DataFrame, most: int) -> DataFrame:
    """Adds ``base`` (copies of every document of the size) and ``extra`` (how many
    documents get one more).  A source's group has a row for each size, so it is
    bounded by its longest text, not by its documents."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        total = copies_of_sizes(g["size"].tolist(), g["n"].tolist(), g["rate"].tolist(), most)
        g["base"] = [t // n for t, n in zip(total, g["n"])]
        g["extra"] = [t % n for t, n in zip(total, g["n"])]
        return g

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rates.schema)
    return rates.groupBy(*KEY).applyInPandas(run, f"{fields}, base long, extra long")


def mix(docs: DataFrame, weights: tuple = (5, 2, 1), most: int = 3) -> DataFrame:
    """(doc_id, none, source, size, h, source_size, target, rate, copies) of every row."""
    rows = stored(sized(docs), "mix-rows")
    sources = stored(targets(rows, weights, most), "mix-targets")
    classes = stored(rows.groupBy(*KEY, "size").agg(F.count(F.lit(1)).alias("n")), "mix-classes")
    duals = solve(classes, sources, most)
    tilt = F.col("lam") * F.col("size") * F.col("docs") / F.col("source_size")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("lam").isNull() | (tilt >= math.log(most)), float(most)).otherwise(F.exp(tilt))
    rates = classes.join(sources, KEY).join(duals, KEY, "left").select(
        *KEY, "size", "n", "source_size", "target", rate.alias("rate"))
    plan = stored(rounded(rates, most).withColumn("parts", F.ceil(F.sqrt("n")).cast("long")), "mix-plan")

    each = rows.join(plan, [*KEY, "size"]).withColumn("part", F.pmod("h", F.col("parts")))
    part = [*KEY, "size", "part"]
    odd = each.where(F.col("extra") > 0).groupBy(*part).agg(
        F.count(F.lit(1)).alias("m"), F.first("extra").alias("k"), F.first("n").alias("of"))
    upto = F.sum("m").over(Window.partitionBy(*KEY, "size").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    share = lambda c: F.floor(F.col("k").cast("decimal(19,0)") * c.cast("decimal(19,0)") / F.col("of"))
    odd = odd.withColumn("upto", upto).select(*part, (share(F.col("upto")) - share(F.col("upto") - F.col("m"))).alias("odd"))
    place = F.row_number().over(Window.partitionBy(*part).orderBy("h", "doc_id"))
    each = each.join(odd, part, "left").withColumn("place", place)
    copies = F.col("base") + F.when(F.col("place") <= F.coalesce("odd", F.lit(0)), 1).otherwise(0)
    return each.select("doc_id", *KEY, "size", "h", "source_size", "target", "rate", copies.alias("copies"))


def mixture(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mixed corpus: the rows of ``docs`` (doc_id, text, source), each as often as
    the plan of ``mix`` says.  Rows equal in all three share their copies."""
    total = plan.groupBy("doc_id", *KEY, "h").agg(F.sum("copies").alias("copies")).where(F.col("copies") > 0)
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "source")
    one = one.dropDuplicates().alias("d")
    t = total.alias("t")
    same = (F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.xxhash64("d.doc_id", "d.text") == F.col("t.h"))
            & (F.col("d.source").isNull() == F.col("t.none")) & (F.coalesce("d.source", F.lit("")) == F.col("t.source")))
    return one.join(t, same).select("d.doc_id", "d.text", "d.source", F.explode(F.sequence(F.lit(1).cast("long"), "t.copies")).alias("copy"))
