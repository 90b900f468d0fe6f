"""Headline timings: prints ONE JSON line.

Runs on $BENCH_SF_DIR (default /root/testdata/sf0.1) with local[$BENCH_CPUS]:
fit of an incremental forest, incremental update, scoring, the whole-table
split search, the class histogram and the evaluation curves.  Each query is
timed twice, cold (its first run, right after the start) and warm; caches are
cleared before every run, so no run reads what another one kept.  The shared
input alone stays cached.  ``queries`` has the warm times, ``cold`` the others.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from grove.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          app="grove-bench")
    spark.sparkContext.setLogLevel("ERROR")

    from grove.operators.evaluate import auc, roc_curve, score_bins
    from grove.operators.forest import IncrementalForest
    from grove.operators.growth import ForestParams
    from grove.operators.sampling import split_batches
    from grove.plans import catalog as C
    from grove.plans import fixtures as FX

    h = split_batches(FX.hyperplane(spark, sf_dir), 4).persist()
    h.count()
    est = IncrementalForest(FX.hyperplane_spec(), ForestParams(num_trees=10, max_depth=5, seed=3))
    state = {}

    def q_fit():
        state["m"] = est.fit(h.where(F.col("batch") == 0))
        return len(state["m"].nodes)

    def q_update():
        state["m1"] = est.update(state["m"], h.where(F.col("batch") == 1))
        return len(state["m1"].nodes)

    def q_score():
        s = state["m1"].transform(h.where(F.col("batch") == 4), keep=["rk", "label"])
        state["scored"] = s.select("label", F.col("probability")[1].alias("score"))
        return s.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]

    def q_roc_auc():
        return auc(roc_curve(score_bins(state["scored"]))).first()[0]

    def q_splits():
        return C.splits_stride(spark, sf_dir).count()

    def q_histogram():
        return C.class_histogram(spark, sf_dir).count()

    def q_summary():
        return C.column_summary(spark, sf_dir).count()

    def q_logistic():
        from grove.operators import logistic as LG
        return LG.fit(h, C.SUMMARY_FEATURES, reg=0.01, max_iter=100).iterations

    plan = [("fit", q_fit), ("update", q_update), ("score", q_score), ("roc_auc", q_roc_auc),
            ("splits_stride", q_splits), ("class_histogram", q_histogram),
            ("column_summary", q_summary), ("logistic_fit", q_logistic)]
    def timed(fn) -> float:
        spark.catalog.clearCache()
        h.persist().count()
        t = time.time()
        fn()
        return round(time.time() - t, 3)

    cold = {name: timed(fn) for name, fn in plan}
    times = {name: timed(fn) for name, fn in plan}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "grove_headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "cold": cold, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
