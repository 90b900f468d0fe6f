"""Model store, S3 and S4.

Every attempt to write a version puts its tables into a folder of its own, and
``meta``, written last, names the attempt a version consists of:

    meta/version=N            one row: attempt, parent, features, settings, rows
                              seen, and the stream batch it came from, if any
    attempts/<id>/splits      feature, split_idx, threshold (frozen candidate splits)
    attempts/<id>/trees       tree_id, weight, max_depth, born_version, stats_version, origin
    attempts/<id>/nodes       tree_id, node_id, is_leaf, feature, split_idx, threshold,
                              left_categories, gain, impurity, count, stats, prediction
    attempts/<id>/leaf_stats  tree_id, node_id, feature, bin, s0.. (written by executors)
    attempts/<id>/metrics     one row, if the version was tested on its batch first

A run that dies before ``meta`` leaves an attempt nobody refers to, so a retry
can't double anything.  A version counts only if its ``parent`` is the attempt
its predecessor consists of now: overwriting version N retires all later
ones.  A tree kept unchanged points at the version holding its leaf
statistics (``stats_version``), so they are not copied.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_SCHEMA = ("tree_id int, node_id bigint, is_leaf boolean, feature int, split_idx int, "
               "threshold double, left_categories array<int>, gain double, impurity double, "
               "count double, stats array<double>, prediction double")
TREE_SCHEMA = ("tree_id int, weight double, max_depth int, born_version int, "
               "stats_version int, origin string")
META_SCHEMA = ("names array<string>, arity array<int>, num_classes int, label string, "
               "params string, rows_seen bigint, bin_counts array<int>, unordered array<boolean>, "
               "attempt string, parent string, stream string, batch bigint")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def new_attempt() -> str:
    return uuid.uuid4().hex


def attempt_path(root: str, attempt: str) -> str:
    return f"{root}/attempts/{attempt}"


def versions(spark: SparkSession, root: str) -> dict:
    """meta rows of the valid versions by number (a few bytes per version)."""
    if not _exists(spark, f"{root}/meta"):
        return {}
    rows = spark.read.schema(META_SCHEMA + ", version int").parquet(f"{root}/meta").collect()
    found = {int(r["version"]): r for r in rows}
    out, parent = {}, None
    for v in sorted(found):
        if v != len(out) or found[v]["parent"] != parent:
            break
        out[v], parent = found[v], found[v]["attempt"]
    return out


def version_exists(spark: SparkSession, root: str, version: int) -> bool:
    return int(version) in versions(spark, root)


def latest_version(spark: SparkSession, root: str) -> int:
    found = versions(spark, root)
    if not found:
        raise FileNotFoundError(f"{root} holds no version")
    return max(found)


def nodes_frame(spark: SparkSession, nodes: pd.DataFrame) -> DataFrame:
    rows = [(int(r.tree_id), int(r.node_id), bool(r.is_leaf), int(r.feature), int(r.split_idx),
             float(r.threshold), [int(c) for c in (r.left_categories or [])], float(r.gain),
             float(r.impurity), float(r.count), [float(s) for s in r.stats], float(r.prediction))
            for r in nodes.itertuples(index=False)]
    return spark.createDataFrame(rows, NODE_SCHEMA)


def trees_frame(spark: SparkSession, trees: pd.DataFrame) -> DataFrame:
    rows = [(int(r.tree_id), float(r.weight), int(r.max_depth), int(r.born_version),
             int(r.stats_version), str(r.origin)) for r in trees.itertuples(index=False)]
    return spark.createDataFrame(rows, TREE_SCHEMA)


def save_version(spark: SparkSession, root: str, version: int, meta: dict, splits_rows,
                 trees: pd.DataFrame, nodes: pd.DataFrame, mode: str = "error",
                 extra=(), attempt: str | None = None, stream: tuple[str, int] | None = None) -> None:
    """S3: writes one version.  Fails if it exists unless mode='overwrite'."""
    have = versions(spark, root)
    if mode != "overwrite" and version in have:
        raise FileExistsError(f"{root} already holds version {version}")
    if version and version - 1 not in have:
        raise FileNotFoundError(f"{root} has no version {version - 1} to follow")
    attempt = attempt or new_attempt()
    base = attempt_path(root, attempt)
    parent = have[version - 1]["attempt"] if version else None
    m = spark.createDataFrame([(meta["names"], meta["arity"], meta["num_classes"], meta["label"],
                                json.dumps(meta["params"]), int(meta["rows_seen"]),
                                meta["bin_counts"], meta["unordered"], attempt, parent,
                                *(stream or (None, None)))], META_SCHEMA)
    s = spark.createDataFrame(splits_rows, "feature int, split_idx int, threshold double")

    def write(item):
        name, df = item
        df.coalesce(1).write.parquet(f"{base}/{name}")

    # small independent jobs: submitted together; meta goes last, so a
    # version is visible only once its tables are complete
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=4) as pool:
        futs = [pool.submit(write, item) for item in
                (("splits", s), ("trees", trees_frame(spark, trees)),
                 ("nodes", nodes_frame(spark, nodes)))]
        futs += [pool.submit(fn) for fn in extra if fn is not None]  # e.g. leaf statistics
        for f in futs:
            f.result()
    (m.withColumn("version", F.lit(int(version))).coalesce(1).write
     .option("partitionOverwriteMode", "dynamic").mode("overwrite")
     .partitionBy("version").parquet(f"{root}/meta"))


def load_version(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """Reads one version's small tables to the driver (bounded by trees
    x nodes); leaf statistics stay a Spark table."""
    have = versions(spark, root)
    if version is None:
        version = max(have, default=0)
    if version not in have:
        raise FileNotFoundError(f"{root} has no version {version}")
    meta = have[version]
    base = attempt_path(root, meta["attempt"])
    splits = spark.read.parquet(f"{base}/splits").toPandas()
    trees = spark.read.parquet(f"{base}/trees").toPandas()
    nodes = spark.read.parquet(f"{base}/nodes").toPandas()
    nodes["left_categories"] = nodes["left_categories"].map(lambda a: [int(x) for x in a])
    nodes["stats"] = nodes["stats"].map(lambda a: [float(x) for x in a])
    return dict(version=int(version), meta=meta.asDict(), splits=splits, trees=trees,
                nodes=nodes)


def write_metrics_row(spark: SparkSession, root: str, attempt: str, row: tuple) -> None:
    from grove.operators.evaluate import METRICS_SCHEMA
    spark.createDataFrame([row], METRICS_SCHEMA).coalesce(1).write.parquet(f"{attempt_path(root, attempt)}/metrics")


def metrics(spark: SparkSession, root: str) -> DataFrame:
    """The metrics rows of all valid versions that have one, with ``version``."""
    from grove.operators.evaluate import METRICS_SCHEMA
    paths = {f"{attempt_path(root, r['attempt'])}/metrics": v for v, r in versions(spark, root).items()}
    paths = {p: v for p, v in paths.items() if _exists(spark, p)}
    if not paths:
        return spark.createDataFrame([], METRICS_SCHEMA + ", version int")
    attempt = F.regexp_extract(F.col("_metadata.file_path"), r"attempts/([0-9a-f]+)/metrics/", 1)
    number = spark.createDataFrame([(p.rsplit("/", 2)[1], v) for p, v in paths.items()], "attempt string, version int")
    rows = spark.read.schema(METRICS_SCHEMA).parquet(*paths).withColumn("attempt", attempt)
    return rows.join(F.broadcast(number), "attempt").drop("attempt")  # a row a version


def leaf_stats(spark: SparkSession, root: str, trees: pd.DataFrame) -> DataFrame | None:
    """Leaf histograms of the given trees, each read from the attempt of its
    stats version alone; None if these have no leaves with data.  Raises if a
    version was written without leaf statistics."""
    have = versions(spark, root)
    out = None
    for v, ids in trees.groupby("stats_version")["tree_id"]:
        meta = have[int(v)]
        if not json.loads(meta["params"]).get("store_leaf_stats", True):
            raise ValueError(f"version {v} of {root} was written without leaf statistics "
                             "(store_leaf_stats=False): its trees can't be grown further")
        path = f"{attempt_path(root, meta['attempt'])}/leaf_stats"
        if not _exists(spark, path):
            continue
        keys = spark.createDataFrame([(int(t),) for t in ids], "tree_id int")
        part = spark.read.parquet(path).join(F.broadcast(keys), "tree_id", "left_semi")
        out = part if out is None else out.unionByName(part)
    return out


def thresholds_from(splits_pd: pd.DataFrame, num_features: int) -> list[np.ndarray]:
    out = []
    for f in range(num_features):
        s = splits_pd[splits_pd.feature == f].sort_values("split_idx")
        out.append(s.threshold.to_numpy(np.float64))
    return out
