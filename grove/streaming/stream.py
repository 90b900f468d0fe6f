"""Model updates from a stream, I13.

``readStream`` over a folder of batch files -> ``foreachBatch``: the first
micro-batch of an empty model store fits the forest, every other one updates its
latest version.  Each version's ``meta`` names the micro-batch it came from
as (checkpoint location, batch id).  After a driver restart Structured Streaming
re-runs the last uncommitted micro-batch; it is skipped exactly if a version from
that very micro-batch exists.  Another source, or the same one with a new
checkpoint, is new data and updates the model.

With ``test_first`` every micro-batch is scored by the latest version before it
trains the next one (test-then-train).  The metrics row is written by the attempt
that writes the version, so a crash or a replay leaves neither twice nor one without
the other; ``model_store.metrics`` reads the rows of all valid versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.operators.evaluate import accuracy
from grove.session import new_work_path
from grove.sources import model_store as MS


def stream_updates(spark: SparkSession, source: str, schema, forest, model_root: str,
                   checkpoint: str | None = None, files_per_batch: int = 1,
                   fmt: str = "parquet", prepare=None, test_first: bool = False) -> dict:
    """Runs the stream until all available files are processed
    (``availableNow``) and returns {'model': latest ForestModel,
    'batches': ids handled, 'skipped': ids replayed}."""
    from grove.operators.forest import ForestModel
    checkpoint = checkpoint or new_work_path(spark, "stream-ckpt")
    state = {"model": None, "batches": [], "skipped": []}

    def report(latest, df: DataFrame, batch_id: int) -> dict | None:
        if not test_first:
            return None
        acc = accuracy(latest.transform(df)).first()["accuracy"] if latest is not None else None
        return dict(batch=batch_id, error=None if acc is None else 1.0 - acc)

    def handle(batch: DataFrame, batch_id: int) -> None:
        mine = (checkpoint, int(batch_id))
        have = MS.versions(spark, model_root)
        if any((r["stream"], r["batch"]) == mine for r in have.values()):  # replay: already applied
            state["skipped"].append(mine[1])
            return
        df = prepare(batch) if prepare else batch
        if have:
            latest = state["model"]
            if latest is None or latest.version != max(have):
                latest = ForestModel.load(spark, model_root)
            state["model"] = forest.update(latest, df, stream=mine, report=report(latest, df, mine[1]))
        else:
            state["model"] = forest.fit(df, model_root, stream=mine, report=report(None, df, mine[1]))
        state["batches"].append(mine[1])

    sdf = (spark.readStream.format(fmt).schema(schema)
           .option("maxFilesPerTrigger", files_per_batch).load(source))
    q = (sdf.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if state["model"] is None and MS.versions(spark, model_root):
        state["model"] = ForestModel.load(spark, model_root)
    return state


def write_batches(df: DataFrame, path: str, batch_col: str, batch_ids, files: int = 1) -> None:
    """Lays a table out as ``files`` files per batch, written in batch order (a file
    stream takes files by modification time, so ``files_per_batch=files`` gives a
    micro-batch for each).  ``batch_ids`` is the known, small list of batch numbers;
    the table is scanned once, into a store of batches, and a batch is written by
    ``files`` tasks.  A batch with fewer rows than files is an
    error, for it would have fewer files."""
    from grove.sources.batches import BatchStore
    store = BatchStore.write(df.where(F.col(batch_col).isin([int(b) for b in batch_ids])), batch_col=batch_col)
    for b in sorted(batch_ids):
        part = store.read(b).drop(batch_col)
        share = part.coalesce(1) if files == 1 else part.repartition(files)
        share.write.mode("append").parquet(f"{path}/batch={b}")
        if files > 1 and len(df.sparkSession.read.schema(store.schema).parquet(f"{path}/batch={b}").inputFiles()) != files:
            raise ValueError(f"batch {b} has too few rows for {files} files")
