"""Distributed ranks and running sums within large groups.

``Window.partitionBy(g).orderBy(v)`` sends a whole group to one task.  Here the rows
are sorted by range over (group, value), with a fixed number of rows to a range, so
that there are as many ranges as the rows ask for and a group may span many of them.
Sums inside a range are one pass over its sorted rows; what lies before a range comes
from a table of range totals, a row for each range and group.
"""

from __future__ import annotations

from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

RANGE_ROWS = 200_000


def _within_ranges(df: DataFrame, part: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Rows of sorted ranges with ``_p`` (the range), ``_rn`` and ``_l_<c>``: position
    and inclusive sums since the group began in this range."""
    part, sums = list(part), list(sums)
    new = [T.StructField("_p", T.IntegerType()), T.StructField("_rn", T.LongType())]
    new += [T.StructField(f"_l_{c}", df.schema[c].dataType) for c in sums]
    schema = T.StructType(df.schema.fields + new)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        p = TaskContext.get().partitionId()
        last, before = None, {}
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            keys = [b.column(c).to_numpy(zero_copy_only=False) for c in part]
            starts = np.zeros(n, dtype=bool)
            for k in keys:
                starts[1:] |= k[1:] != k[:-1]
            first = tuple(k[0] for k in keys)
            starts[0] = last is None or first != last
            at = np.flatnonzero(starts)
            run = np.cumsum(starts) - 1  # -1: goes on from the batch before
            out = list(b.columns) + [pa.array(np.full(n, p, np.int32))]
            for name, x in [("", np.ones(n, np.int64)), *((c, b.column(c).to_numpy(zero_copy_only=False)) for c in sums)]:
                total = np.cumsum(x)
                base = np.concatenate([total[at] - x[at], [-before.get(name, 0)]])  # last: for run -1
                mine = total - base[run]
                before[name] = mine[-1]
                out.append(pa.array(mine))
            last = tuple(k[-1] for k in keys)
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(out, types)], names=[f.name for f in schema.fields])

    from pyspark.sql.pandas.types import to_arrow_schema
    types = [f.type for f in to_arrow_schema(schema)]
    return df.mapInArrow(fn, schema)


def running_sums(df: DataFrame, part: Sequence[str], order: str, sums: Sequence[str],
                 descending: bool = False, totals: bool = False, range_rows: int | None = None) -> DataFrame:
    """Adds ``rank`` (1-based position by ``order`` within ``part``; rows
    must be distinct on part + order) and ``cum_<c>`` running sums
    (inclusive) for each column in ``sums``.  With ``totals`` also the
    group's row count ``tot_rows`` and sums ``tot_<c>`` (from the small
    range table, no extra pass over the rows).  ``df`` is counted and sampled
    before it is sorted: persist it when it is expensive."""
    part, sums = list(part), list(sums)
    keys = [F.col(c).asc() for c in part] + [F.col(order).desc() if descending else F.col(order).asc()]
    ranges = max(1, -(-df.count() // int(range_rows or RANGE_ROWS)))
    placed = df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    local = _within_ranges(placed, part, sums).persist(StorageLevel.MEMORY_AND_DISK)
    tots = local.groupBy(*part, "_p").agg(F.count(F.lit(1)).alias("_tn"), *[F.sum(c).alias(f"_t_{c}") for c in sums])
    wo = Window.partitionBy(*part).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    wall = Window.partitionBy(*part)
    offs = tots.select(*part, "_p", F.coalesce(F.sum("_tn").over(wo), F.lit(0)).alias("_on"),
                       *[F.coalesce(F.sum(f"_t_{c}").over(wo), F.lit(0)).alias(f"_o_{c}") for c in sums],
                       *([F.sum("_tn").over(wall).alias("tot_rows")]
                         + [F.sum(f"_t_{c}").over(wall).alias(f"tot_{c}") for c in sums] if totals else []))
    # at most a row for each range and for each group: Spark broadcasts it while it is small
    out = local.join(offs, [*part, "_p"]).withColumn("rank", F.col("_rn") + F.col("_on"))
    for c in sums:
        out = out.withColumn(f"cum_{c}", F.col(f"_l_{c}") + F.col(f"_o_{c}"))
    return out.drop("_p", "_rn", "_on", *[f"_l_{c}" for c in sums], *[f"_o_{c}" for c in sums])
