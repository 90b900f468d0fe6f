"""Registered queries: one Spark builder per operator (``QUERIES``) and, where
the operator is expressible in SQL, its DuckDB oracle (``ORACLES``).

Every builder reads the supplied tables under ``sf_dir`` (whole tables) and
returns a DataFrame; computed columns carry the same names on both sides,
floats are rounded to 6 decimals and counts are BIGINT.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.functions import hashing as H
from grove.functions import impurity as I
from grove.operators import features as P
from grove.operators import histogram as Hg
from grove.operators import sampling as B
from grove.operators import splits as Q
from grove.operators import stats as L
from grove.plans import fixtures as FX
from grove.plans import oracle_sql as O
from grove.sources.tables import read_table

QUERIES: dict = {}
ORACLES: dict = {}

MAX_BINS = 32


def query(name: str, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql() if callable(sql) else sql
        return fn
    return deco


def rnd(c, d: int = 6):
    return F.round(F.col(c).cast("double"), d) if isinstance(c, str) else F.round(c.cast("double"), d)


# ===================================================================== P
@query("prep_cast_numeric", """
SELECT l_orderkey, l_partkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber, l_quantity
FROM lineitem""")
def prep_cast_numeric(spark: SparkSession, sf: str) -> DataFrame:
    """Every integer column to double, in one projection."""
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber",
                                                  "l_quantity")
    return P.cast_int_columns(li)


_K_TEXT = "regexp_extract(props, '[0-9]+', 0)"


@query("prep_parse_strings", f"""
SELECT event_id, event_type,
       CAST(CASE WHEN {_K_TEXT} = '' THEN '0' ELSE {_K_TEXT} END AS DOUBLE) AS k_text,
       CAST(CASE WHEN event_type = 'view' THEN '0' ELSE {_K_TEXT} END AS DOUBLE) AS k_or_empty
FROM events""")
def prep_parse_strings(spark, sf):
    """Numeric strings parsed, '' read as 0, listed columns left alone."""
    e = read_table(spark, sf, "events")
    k = F.regexp_extract("props", "[0-9]+", 0)
    s = e.select("event_id", "event_type", k.alias("k_text"),
                 F.when(F.col("event_type") == "view", F.lit("")).otherwise(k).alias("k_or_empty"))
    return P.parse_string_columns(s, exclude=["event_type"])


@query("prep_binarize", """
SELECT event_id, CASE WHEN value > 10.0 THEN 1.0 ELSE 0.0 END AS value_high FROM events""")
def prep_binarize(spark, sf):
    """P7."""
    e = read_table(spark, sf, "events").select("event_id", "value")
    return P.binarize(e, "value", 10.0, "value_high").select("event_id", "value_high")


@query("prep_feature_columns", """
SELECT CAST(l_linenumber AS DOUBLE) AS l_linenumber, l_quantity, l_extendedprice, l_discount
FROM lineitem""")
def prep_feature_columns(spark, sf):
    """Double columns, not the label, name of 4+ characters."""
    li = P.cast_int_columns(read_table(spark, sf, "lineitem"))
    li = li.withColumnRenamed("l_tax", "tax")  # a 3-character name is skipped
    cols = P.numeric_feature_columns(li, label="tax", exclude=["l_orderkey"])
    assert P.string_columns(li, ["l_returnflag", "l_linestatus"]) == ["l_returnflag", "l_linestatus"]
    return li.select(*cols)


@query("prep_string_index", f"""
SELECT o_orderkey, p.idx AS priority_idx FROM orders JOIN (
SELECT o_orderpriority AS v, CAST(row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1
AS DOUBLE) AS idx FROM orders GROUP BY o_orderpriority) p ON o_orderpriority = p.v""")
def prep_string_index(spark, sf):
    """Frequency-ordered index (ties by value)."""
    o = read_table(spark, sf, "orders")
    out, _ = P.string_index(o, "o_orderpriority", "priority_idx")
    return out.select("o_orderkey", "priority_idx")


def _one_hot_sql():
    cols = ", ".join(f"CASE WHEN p.idx = {i}.0 THEN 1.0 ELSE 0.0 END AS oh_{i}" for i in range(4))
    return (f"SELECT o_orderkey, {cols} FROM orders JOIN (SELECT o_orderpriority AS v, "
            f"CAST(row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS DOUBLE) AS idx "
            f"FROM orders GROUP BY o_orderpriority) p ON o_orderpriority = p.v")


@query("prep_one_hot", _one_hot_sql)
def prep_one_hot(spark, sf):
    """Index then one-hot, last category dropped."""
    o = read_table(spark, sf, "orders")
    out, idx = P.string_index(o, "o_orderpriority", "priority_idx")
    out = P.one_hot_columns(out, "priority_idx", len(idx.labels), "oh")
    return out.select("o_orderkey", *[f"oh_{i}" for i in range(len(idx.labels) - 1)])


@query("prep_assemble")
def prep_assemble(spark, sf):
    """Instances (label, weight, features array)."""
    h = FX.hyperplane(spark, sf)
    return P.instances(P.assemble(h, FX.HYPER_FEATURES), "label")


# ===================================================================== B
def _batches_sql():
    items, u = O.hash_u("bh", B.SEED_BATCH, ["rk"])
    return (f"SELECT event_id, CAST(least(floor({u} * CAST(12.5 AS DOUBLE)), 10) AS INTEGER) AS batch "
            f"FROM (SELECT *, {items} FROM ({FX.events_sql()}))")


@query("batches_equal_holdout", _batches_sql)
def batches_equal_holdout(spark, sf):
    """B1: 10 equal batches plus a hold-out of weight 10/4."""
    e = FX.events(spark, sf)
    return B.split_batches(e, 10).select("event_id", "batch")


def _sample_sql():
    return f"SELECT rk FROM ({O.sample_sql(FX.hyperplane_sql(), MAX_BINS)})"


@query("quantile_sample", _sample_sql)
def quantile_sample(spark, sf):
    """B2: Bernoulli sample of max(maxBins^2, 10000) rows in expectation."""
    h = FX.hyperplane(spark, sf)
    n = h.count()
    return B.quantile_sample(h, B.quantile_fraction(MAX_BINS, n)).select("rk")


def _bag_sql():
    items, u = O.hash_u("bh", B.SEED_BAG, ["t.tree_id", "e.rk"])
    return (f"SELECT event_id, CAST(tree_id AS INTEGER) AS tree_id, "
            f"CAST({H.poisson_sql(u)} AS INTEGER) AS weight FROM (SELECT e.event_id, t.tree_id, {items} "
            f"FROM ({FX.events_sql()}) e, range(5) t(tree_id))")


@query("bag_weights", _bag_sql)
def bag_weights(spark, sf):
    """Poisson(1) weight per (row, tree)."""
    e = FX.events(spark, sf)
    return B.bag_weights(e, 5, keep=["event_id"]).select("event_id", "tree_id", "weight")


@query("union_batches", f"""
SELECT day, count(*) AS n, {O.r6('sum(label)')} AS positives FROM ({FX.events_sql()}) GROUP BY day""")
def union_batches(spark, sf):
    """Cumulative training set = union of the daily batches."""
    e = FX.events(spark, sf)
    days = [r[0] for r in e.select("day").distinct().collect()]  # one per batch file
    # each batch is read with its own timestamp range (pushed into the scan)
    u = B.union_batches([FX.events(spark, sf, day=d) for d in sorted(days)])
    return u.groupBy("day").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("label")).alias("positives"))


# ===================================================================== Q
def _value_counts_sql():
    return (f"SELECT feature, v, count(*) AS n FROM ({O.long_sql(FX.hyperplane_sql(), FX.HYPER_FEATURES)}) "
            f"GROUP BY feature, v")


@query("value_counts", _value_counts_sql)
def value_counts(spark, sf):
    """Q1."""
    return Q.value_counts(FX.hyperplane(spark, sf), FX.HYPER_FEATURES)


@query("splits_stride",
       lambda: O.thresholds_sql(O.long_sql(FX.hyperplane_sql(), FX.HYPER_FEATURES), MAX_BINS - 1))
def splits_stride(spark, sf):
    """Q2/Q3 over the whole table (distributed ranks; no group in one task)."""
    from pyspark import StorageLevel
    vc = Q.value_counts(FX.hyperplane(spark, sf), FX.HYPER_FEATURES)
    return Q.continuous_thresholds(vc.persist(StorageLevel.MEMORY_AND_DISK), MAX_BINS - 1)


def _part_long():
    return ("SELECT 0 AS feature, p_retailprice AS v FROM part UNION ALL "
            "SELECT 1 AS feature, CAST(p_size AS DOUBLE) AS v FROM part")


@query("splits_part", lambda: O.thresholds_sql(_part_long(), MAX_BINS - 1))
def splits_part(spark, sf):
    """Q3 on part: 1000 distinct prices -> 31 thresholds."""
    p = read_table(spark, sf, "part")
    return Q.continuous_thresholds(Q.value_counts(p, ["p_retailprice", "p_size"]), MAX_BINS - 1)


def _subsets_sql():
    return ("SELECT feature, CAST(s AS INTEGER) AS split_idx, CAST(s + 1 AS BIGINT) AS left_mask, "
            "(SELECT string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FROM range(arity) r(c) "
            "WHERE ((s + 1) >> c) & 1 = 1) AS categories FROM ("
            "SELECT 0 AS feature, count(DISTINCT o_orderpriority) AS arity FROM orders UNION ALL "
            "SELECT 1, count(DISTINCT o_orderstatus) FROM orders) a, "
            "range(CAST(pow(2, arity - 1) AS BIGINT) - 1) t(s)")


@query("splits_unordered_subsets", _subsets_sql)
def splits_unordered_subsets(spark, sf):
    """Q5: candidate left sets of unordered categorical features."""
    o = read_table(spark, sf, "orders")
    ar = o.agg(F.countDistinct("o_orderpriority").alias("a0"),
               F.countDistinct("o_orderstatus").alias("a1"))
    arity = ar.select(F.explode(F.array(
        F.struct(F.lit(0).alias("feature"), F.col("a0").cast("int").alias("arity")),
        F.struct(F.lit(1).alias("feature"), F.col("a1").cast("int").alias("arity")))).alias("x")
    ).select("x.*")
    return Q.unordered_subsets(arity)


# ===================================================================== A
def _root_hist_spark(spark, sf, df=None, splits=None, names=None):
    """Root histogram of one unbagged tree over all hyperplane features,
    with whole-table thresholds."""
    from grove.operators.growth import GrowState, root_row
    h = FX.hyperplane(spark, sf) if df is None else df
    names = names or FX.HYPER_FEATURES
    if splits is None:
        rows = splits_stride(spark, sf).collect()
        import numpy as np
        th = [np.array(sorted(r.threshold for r in rows if r.feature == f)) for f in range(len(names))]
        splits = Q.Splits(th, [len(t) + 1 for t in th], [False] * len(names))
    st = GrowState()
    st.nodes[(0, 1)] = root_row(0, 2)
    fo = Hg.FlatForest.build(st.frame(), [0], 1)
    return Hg.histogram_pass(h, names, [0] * len(names), splits, 2, fo, {0: 0}, [(0, 1)],
                             len(names), 1, 1.0, 0), splits


def _hist_sql(base=None, features=None):
    base = base or FX.hyperplane_sql()
    features = features or FX.HYPER_FEATURES
    th = O.thresholds_sql(O.long_sql(FX.hyperplane_sql(), FX.HYPER_FEATURES), MAX_BINS - 1)
    return O.binned_sql(O.long_sql(base, features), th)


@query("class_histogram", lambda: f"""
SELECT CAST(0 AS INTEGER) AS tree_id, CAST(1 AS BIGINT) AS node_id, feature, bin,
       CAST(label AS INTEGER) AS class, CAST(count(*) AS DOUBLE) AS w
FROM ({_hist_sql()}) GROUP BY ALL""")
def class_histogram(spark, sf):
    """A3/A5: root histogram (feature, bin, class, w) via the Arrow pass."""
    hist, _ = _root_hist_spark(spark, sf)
    return Hg.to_long(hist, 2)


@query("merge_histogram", lambda: f"""
SELECT feature, bin, CAST(label AS INTEGER) AS class, CAST(count(*) AS DOUBLE) AS w
FROM ({_hist_sql()}) GROUP BY ALL""")
def merge_histogram(spark, sf):
    """Histogram of two batches merged = histogram of their union."""
    h = FX.hyperplane(spark, sf)
    h = B.split_batches(h, 2, holdout=False)  # two hashed halves
    h0, splits = _root_hist_spark(spark, sf, h.where(F.col("batch") == 0))
    h1, _ = _root_hist_spark(spark, sf, h.where(F.col("batch") == 1), splits)
    return Hg.to_long(Hg.merge_histograms([h0, h1], 2), 2).drop("tree_id", "node_id")


def _group_counts_sql():
    return (f"SELECT l_returnflag, l_linestatus, sum(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END) AS c0, "
            f"sum(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END) AS c1, "
            f"CAST(count(*) AS DOUBLE) AS n, sum(l_extendedprice) AS s, "
            f"sum(l_extendedprice * l_extendedprice) AS s2 FROM (SELECT *, {FX.HYPER_LABEL_SQL} AS "
            f"label FROM lineitem) GROUP BY ALL")


def _group_counts(spark, sf):
    li = read_table(spark, sf, "lineitem")
    lab = F.when(F.col("l_quantity") + 3 * F.round(F.col("l_discount") * 100)
                 + 2 * F.round(F.col("l_tax") * 100) > 48, 1.0).otherwise(0.0)
    return (li.withColumn("label", lab).groupBy("l_returnflag", "l_linestatus")
            .agg(F.sum(F.when(F.col("label") == 0, 1.0).otherwise(0.0)).alias("c0"),
                 F.sum(F.when(F.col("label") == 1, 1.0).otherwise(0.0)).alias("c1"),
                 F.count(F.lit(1)).cast("double").alias("n"), F.sum("l_extendedprice").alias("s"),
                 F.sum(F.col("l_extendedprice") * F.col("l_extendedprice")).alias("s2")))


@query("impurity_gini_entropy", lambda: f"""
SELECT l_returnflag, l_linestatus, {O.r6(I.gini_sql(['c0', 'c1']))} AS gini,
       {O.r6(I.entropy_sql(['c0', 'c1']))} AS entropy FROM ({_group_counts_sql()})""")
def impurity_gini_entropy(spark, sf):
    """A7/A8 per group of the hyperplane label."""
    g = _group_counts(spark, sf)
    cs = [F.col("c0"), F.col("c1")]
    return g.select("l_returnflag", "l_linestatus", rnd(I.gini(cs)).alias("gini"),
                    rnd(I.entropy(cs)).alias("entropy"))


@query("impurity_variance", lambda: f"""
SELECT l_returnflag, l_linestatus, round({I.variance_sql('n', 's', 's2')} / 1000000.0, 3) AS variance_m
FROM ({_group_counts_sql()})""")
def impurity_variance(spark, sf):
    """Variance of l_extendedprice per group (in millions, 3 decimals)."""
    g = _group_counts(spark, sf)
    return g.select("l_returnflag", "l_linestatus",
                    F.round(I.variance(F.col("n"), F.col("s"), F.col("s2")) / 1e6, 3).alias("variance_m"))


@query("leaf_probability", lambda: f"""
SELECT l_returnflag, l_linestatus, CASE WHEN c1 > c0 THEN 1.0 ELSE 0.0 END AS prediction,
       {O.r6('c0 / (c0 + c1)')} AS p0, {O.r6('c1 / (c0 + c1)')} AS p1 FROM ({_group_counts_sql()})""")
def leaf_probability(spark, sf):
    """A10: majority class (first on ties) and class shares."""
    g = _group_counts(spark, sf)
    cs = [F.col("c0"), F.col("c1")]
    return g.select("l_returnflag", "l_linestatus", I.predict("gini", cs).alias("prediction"),
                    rnd(F.col("c0") / (F.col("c0") + F.col("c1"))).alias("p0"),
                    rnd(F.col("c1") / (F.col("c0") + F.col("c1"))).alias("p1"))


@query("label_histogram", """
SELECT CAST(o_orderstatus = 'F' AS DOUBLE) + CAST(o_orderstatus = 'P' AS DOUBLE) * 2 AS label,
       CAST(count(*) AS DOUBLE) AS weight, count(*) AS n, true AS valid FROM orders GROUP BY 1""")
def label_histogram(spark, sf):
    """Weight per label value with validity."""
    o = read_table(spark, sf, "orders")
    y = (F.col("o_orderstatus") == "F").cast("double") + (F.col("o_orderstatus") == "P").cast("double") * 2
    return L.label_histogram(o.withColumn("y", y), "y")


# ===================================================================== T
def _root_cands_sql():
    hist = (f"SELECT CAST(0 AS INTEGER) AS tree_id, CAST(1 AS BIGINT) AS node_id, feature, bin, "
            f"sum(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END) AS s0, "
            f"sum(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END) AS s1 FROM ({_hist_sql()}) GROUP BY ALL")
    th = O.thresholds_sql(O.long_sql(FX.hyperplane_sql(), FX.HYPER_FEATURES), MAX_BINS - 1)
    return O.candidates_sql(hist, O.nbins_sql(th, 4), "gini", 2), th


def _root_cands_spark(spark, sf):
    from grove.operators.growth import scored_candidates, split_candidates
    hist, splits = _root_hist_spark(spark, sf)
    return scored_candidates(split_candidates(hist, [0] * 4, splits, 2), 2, "gini", 1.0), splits


@query("split_gains", lambda: f"""
SELECT feature, CAST(bin AS INTEGER) AS split_idx, CAST(left_count AS DOUBLE) AS left_count,
       CAST(right_count AS DOUBLE) AS right_count, {O.r6('gain')} AS gain, valid
FROM ({_root_cands_sql()[0]})""")
def split_gains(spark, sf):
    """Gain and validity of every root candidate."""
    sc, _ = _root_cands_spark(spark, sf)
    return sc.where("_ok").select("feature", "split_idx", F.col("left_count").cast("double").alias("left_count"),
                     F.col("right_count").cast("double").alias("right_count"),
                     rnd("gain").alias("gain"), "valid")


def _best_root_sql():
    c, th = _root_cands_sql()
    return f"""
    SELECT b.feature, CAST(b.bin AS INTEGER) AS split_idx, t.threshold, {O.r6('b.gain')} AS gain
    FROM (SELECT * FROM ({c}) WHERE valid ORDER BY gain DESC, feature, bin LIMIT 1) b
    JOIN ({th}) t ON t.feature = b.feature AND t.split_idx = b.bin"""


@query("best_split_continuous", _best_root_sql)
def best_split_continuous(spark, sf):
    """Best root split (first feature, first split on ties)."""
    from grove.operators.growth import best_splits
    hist, splits = _root_hist_spark(spark, sf)
    b = best_splits(hist, [0] * 4, splits, 2, "gini", 1.0, 0.0).select("b.*")
    th = F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in t]) if len(t) else
                                F.array().cast("array<double>") for t in splits.thresholds]),
                      F.col("feature") + 1)
    return b.select("feature", "split_idx", F.element_at(th, F.col("split_idx") + 1).alias("threshold"),
                    rnd("gain").alias("gain"))


# ============================================================ trees / forests
def _fit(spark, df, spec, **kw):
    from grove.operators.forest import IncrementalForest
    from grove.operators.growth import ForestParams
    return IncrementalForest(spec, ForestParams(**kw)).fit(df)


def _nodes_out(model, spark, C=2):
    n = model.nodes_df(spark)
    return n.select("tree_id", "node_id", "is_leaf", "feature", "split_idx",
                    F.when(F.col("is_leaf"), F.lit(0.0)).otherwise(rnd("gain")).alias("gain"),
                    *[rnd(F.col("stats")[c]).alias(f"c{c}") for c in range(C)])


def _nodes_sql(fs, C=2):
    return (f"{fs['with']} SELECT CAST(tree_id AS INTEGER) AS tree_id, node_id, is_leaf, "
            f"CAST(feature AS INTEGER) AS feature, CAST(split_idx AS INTEGER) AS split_idx, "
            f"{O.r6('gain')} AS gain, " + ", ".join(O.r6(f"c{c}") + f" AS c{c}" for c in range(C))
            + " FROM nodes")


TREE = dict(num_trees=1, max_depth=3, seed=0)
FOREST = dict(num_trees=5, max_depth=3, seed=0)  # sqrt of 4 features -> 2 per node
ERF = dict(num_trees=3, max_depth=2, seed=0, erf=True)
REG = dict(num_trees=1, max_depth=3, seed=0, impurity="variance")
REG_FEATURES = ["l_discount", "l_tax", "l_extendedprice"]


def _tree_sql():
    return _nodes_sql(O.forest_sql(FX.hyperplane_sql(), FX.HYPER_FEATURES, num_trees=1, max_depth=3))


@query("tree_nodes", _tree_sql)
def tree_nodes(spark, sf):
    """One tree (no bagging, all features), depth 3, node table."""
    m = _fit(spark, FX.hyperplane(spark, sf), FX.hyperplane_spec(), **TREE)
    return _nodes_out(m, spark)


def _forest_sql_dict():
    return O.forest_sql(FX.hyperplane_sql(), FX.HYPER_FEATURES, num_trees=5, max_depth=3,
                        subset_k=2)


@query("forest_nodes", lambda: _nodes_sql(_forest_sql_dict()))
def forest_nodes(spark, sf):
    """T9 with bagging (B3) and per-node feature subsets."""
    m = _fit(spark, FX.hyperplane(spark, sf), FX.hyperplane_spec(), **FOREST)
    return _nodes_out(m, spark)


@query("erf_nodes", lambda: _nodes_sql(O.forest_sql(
    FX.hyperplane_sql(), FX.HYPER_FEATURES, num_trees=3, max_depth=2, subset_k=2, erf=True)))
def erf_nodes(spark, sf):
    """Extremely randomised splits (one hashed threshold per feature)."""
    m = _fit(spark, FX.hyperplane(spark, sf), FX.hyperplane_spec(), **ERF)
    return _nodes_out(m, spark)


def _reg_base_sql():
    return (f"SELECT rk, CAST(l_quantity AS DOUBLE) AS label, {', '.join(REG_FEATURES)} "
            f"FROM ({FX.hyperplane_sql()})")


def _reg_df(spark, sf):
    return FX.hyperplane(spark, sf).select("rk", F.col("l_quantity").alias("label"), *REG_FEATURES)


@query("regression_tree_nodes", lambda: _nodes_sql(O.forest_sql(
    _reg_base_sql(), REG_FEATURES, num_trees=1, max_depth=3, kind="variance", num_classes=0), 3))
def regression_tree_nodes(spark, sf):
    """Variance tree predicting l_quantity (count, sum, sum of squares)."""
    from grove.operators.features import FeatureSpec
    spec = FeatureSpec(list(REG_FEATURES), [0] * 3, "label", 0)
    m = _fit(spark, _reg_df(spark, sf), spec, **REG)
    return _nodes_out(m, spark, 3)


def _pred_sql(fs, depth, base_filter="", pred_only=False):
    route = O.route_sql("SELECT * FROM binned" + base_filter, "SELECT * FROM nodes", depth)
    return f"""{fs['with']},
    leafs AS ({route}),
    votes AS (SELECT l.rk, sum(CASE WHEN n.c0 + n.c1 > 0 THEN n.c0 / (n.c0 + n.c1) ELSE 0 END) AS r0,
                     sum(CASE WHEN n.c0 + n.c1 > 0 THEN n.c1 / (n.c0 + n.c1) ELSE 0 END) AS r1
              FROM leafs l JOIN nodes n ON n.tree_id = l.tree_id AND n.node_id = l.node_id
              GROUP BY l.rk),
    pred AS (SELECT v.rk, b.label, CASE WHEN r1 > r0 THEN 1.0 ELSE 0.0 END AS prediction,
                    CASE WHEN r0 + r1 > 0 THEN r1 / (r0 + r1) ELSE 0.0 END AS p1
             FROM votes v JOIN base b ON b.rk = v.rk)"""


_MODELS: dict = {}


def _forest_model(spark, sf):
    """The shared 5-tree forest; fitted once per session and table folder
    (it is deterministic), then reused by the scoring/inspection queries."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        _MODELS[key] = _fit(spark, FX.hyperplane(spark, sf), FX.hyperplane_spec(), **FOREST)
    return _MODELS[key]


def _forest_scored(spark, sf, df=None):
    m = _forest_model(spark, sf)
    df = FX.hyperplane(spark, sf) if df is None else df
    return m.transform(df, keep=["rk", "label"]).select(
        "rk", "label", "prediction", F.col("probability")[1].alias("p1")), m


@query("forest_predictions",
       lambda: _pred_sql(_forest_sql_dict(), 3) + f" SELECT rk, prediction, {O.r6('p1')} AS p1 FROM pred")
def forest_predictions(spark, sf):
    """M1-M4: weighted votes of leaf class shares, normalised; argmax."""
    s, _ = _forest_scored(spark, sf)
    return s.select("rk", "prediction", rnd("p1").alias("p1"))


@query("tree_predictions", lambda: _pred_sql(
    O.forest_sql(FX.hyperplane_sql(), FX.HYPER_FEATURES, num_trees=1, max_depth=3), 3)
    + " SELECT rk, prediction FROM pred")
def tree_predictions(spark, sf):
    """M5: single-tree majority prediction."""
    from grove.operators.score import transform_tree
    m = _fit(spark, FX.hyperplane(spark, sf), FX.hyperplane_spec(), **TREE)
    return transform_tree(m, FX.hyperplane(spark, sf), 0, keep=["rk"]).select("rk", "prediction")


@query("accuracy", lambda: _pred_sql(_forest_sql_dict(), 3)
       + f" SELECT {O.r6('avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END)')} AS accuracy, "
         "count(*) AS n FROM pred")
def accuracy(spark, sf):
    """Share of correct predictions (micro precision)."""
    from grove.operators.evaluate import accuracy as acc
    s, _ = _forest_scored(spark, sf)
    return acc(s)


@query("confusion", lambda: _pred_sql(_forest_sql_dict(), 3)
       + " SELECT label, prediction, count(*) AS n FROM pred GROUP BY ALL")
def confusion(spark, sf):
    """E1 detail: confusion counts."""
    from grove.operators.evaluate import confusion as conf
    s, _ = _forest_scored(spark, sf)
    return conf(s)


def _imp_sql():
    fs = _forest_sql_dict()
    return f"""{fs['with']},
    per AS (SELECT tree_id, feature, sum(gain * (c0 + c1)) AS g FROM nodes WHERE NOT is_leaf
            GROUP BY ALL),
    norm AS (SELECT feature, g / sum(g) OVER (PARTITION BY tree_id) AS g FROM per)
    SELECT CAST(feature AS INTEGER) AS feature, {O.r6('sum(g) / (SELECT sum(g) FROM norm)')} AS importance
    FROM norm GROUP BY feature"""


@query("feature_importance", _imp_sql)
def feature_importance(spark, sf):
    """M7: gain x count per tree and feature, normalised per tree, summed,
    normalised."""
    from grove.operators.inspect import feature_importance as fi
    m = _forest_model(spark, sf)
    return fi(m.nodes_df(spark)).select("feature", rnd("importance").alias("importance"))


@query("tree_shape", lambda: f"""{_forest_sql_dict()['with']}
    SELECT CAST(tree_id AS INTEGER) AS tree_id, count(*) AS num_nodes,
           CAST(sum(CASE WHEN is_leaf THEN 1 ELSE 0 END) AS BIGINT) AS num_leaves,
           CAST(max(floor(log2(node_id))) AS INTEGER) AS depth FROM nodes GROUP BY tree_id""")
def tree_shape(spark, sf):
    """M8: node count, leaf count, depth per tree."""
    from grove.operators.inspect import tree_shape as ts
    return ts(_forest_model(spark, sf).nodes_df(spark))


def _rules_sql():
    fs = _forest_sql_dict()
    return f"""{fs['with']},
    anc AS (SELECT l.tree_id, l.node_id AS leaf, k.k, l.node_id >> k.k AS anc,
                   (l.node_id >> (k.k - 1)) & 1 AS side
            FROM nodes l, range(1, 31) k(k) WHERE l.is_leaf AND (l.node_id >> k.k) >= 1)
    SELECT CAST(a.tree_id AS INTEGER) AS tree_id, a.leaf AS node_id,
           string_agg('f' || CAST(n.feature AS VARCHAR) || CASE WHEN a.side = 0 THEN ' <= ' ELSE ' > ' END
                      || CAST(n.split_idx AS VARCHAR), ' and ' ORDER BY a.k DESC) AS rule
    FROM anc a JOIN nodes n ON n.tree_id = a.tree_id AND n.node_id = a.anc GROUP BY ALL"""


@query("tree_rules", _rules_sql)
def tree_rules(spark, sf):
    """M9: one rule per leaf below the root: the path as text."""
    from grove.operators.inspect import tree_rules as tr
    return tr(_forest_model(spark, sf).nodes_df(spark), style="bins").select("tree_id", "node_id", "rule")


# ======================================================================= L
SUMMARY_FEATURES = ["l_quantity", "l_discount", "l_tax"]


def _summary_sql():
    parts = []
    for f in SUMMARY_FEATURES:
        w = "(label + 1.0)"
        s1, s2, W, W2 = f"sum({w} * {f})", f"sum({w} * {f} * {f})", f"sum({w})", f"sum({w} * {w})"
        var = f"greatest(CASE WHEN {W} - {W2} / {W} > 0 THEN ({s2} - {s1} * {s1} / {W}) / ({W} - {W2} / {W}) ELSE 0.0 END, 0.0)"
        parts.append(
            f"SELECT '{f}' AS feature, count({f}) AS count, {O.r6(f'{s1} / {W}')} AS mean, "
            f"{O.r6(var)} AS variance, {O.r6(f'min({f})')} AS min, {O.r6(f'max({f})')} AS max, "
            f"{O.r6(f'sum(CASE WHEN {f} <> 0 THEN {w} ELSE 0.0 END)')} AS num_nonzeros, "
            f"{O.r6(f'sum({w} * abs({f}))')} AS norm_l1, {O.r6(f'sqrt({s2})')} AS norm_l2 "
            f"FROM ({FX.hyperplane_sql()})")
    return " UNION ALL ".join(parts)


def _round_summary(df):
    return df.select("feature", "count", *[rnd(c).alias(c) for c in
                     ["mean", "variance", "min", "max", "num_nonzeros", "norm_l1", "norm_l2"]])


@query("column_summary", _summary_sql)
def column_summary(spark, sf):
    """L1: weighted count, mean, unbiased variance, min, max, non-zeros, norms."""
    h = FX.hyperplane(spark, sf).withColumn("w", F.col("label") + 1.0)
    return _round_summary(L.column_summary(h, SUMMARY_FEATURES, "w"))


@query("column_summary_merged", _summary_sql)
def column_summary_merged(spark, sf):
    """L2: moments of two batches merged exactly = summary of their union."""
    h = B.split_batches(FX.hyperplane(spark, sf).withColumn("w", F.col("label") + 1.0), 2,
                        holdout=False)
    m0 = L.moments(h.where(F.col("batch") == 0), SUMMARY_FEATURES, "w")
    m1 = L.moments(h.where(F.col("batch") == 1), SUMMARY_FEATURES, "w")
    return _round_summary(L.summary_from_moments(L.merge_moments(m0, m1)))


@query("joint_label_histogram", f"""
SELECT label, {O.r6('sum(label + 1.0)')} AS weight, count(*) AS n, true AS valid
FROM ({FX.hyperplane_sql()}) GROUP BY label""")
def joint_label_histogram(spark, sf):
    """L4: label histogram from the same single scan as the feature moments."""
    h = FX.hyperplane(spark, sf).withColumn("w", F.col("label") + 1.0)
    _, labels = L.joint_summary(h, SUMMARY_FEATURES, "label", "w")
    return labels.select("label", rnd("weight").alias("weight"), "n", "valid")


LR_BETA = [0.5, -0.25, 0.1]
LR_B = -0.2
LR_REG = 0.1


def _lr_sql():
    sd = {f: f"(SELECT sqrt(var_samp({f})) FROM lineitem)" for f in SUMMARY_FEATURES}
    m = f"{LR_B}" + "".join(f" + {f} * ({b} / {sd[f]})" for f, b in zip(SUMMARY_FEATURES, LR_BETA))
    loss = (f"CASE WHEN m > 0 THEN m + ln(1 + exp(-m)) ELSE ln(1 + exp(m)) END - label * m")
    mult = "(1.0 / (1.0 + exp(-m)) - label)"
    pen = 0.5 * LR_REG * sum(b * b for b in LR_BETA)
    grads = " UNION ALL ".join(
        f"SELECT 'g{i}' AS name, {O.r6(f'sum({mult} * {f} / {sd[f]}) / count(*) + {LR_REG * b}')} AS value FROM d"
        for i, (f, b) in enumerate(zip(SUMMARY_FEATURES, LR_BETA)))
    return (f"WITH d AS (SELECT *, {m} AS m FROM ({FX.hyperplane_sql()})) "
            f"SELECT 'loss' AS name, {O.r6(f'sum({loss}) / count(*) + {pen}')} AS value FROM d "
            f"UNION ALL {grads} UNION ALL "
            f"SELECT 'g_intercept' AS name, {O.r6(f'sum({mult}) / count(*)')} AS value FROM d")


@query("logistic_loss_gradient", _lr_sql)
def logistic_loss_gradient(spark, sf):
    """Loss and gradient at fixed standardised coefficients, L2 penalty."""
    import numpy as np
    from grove.operators import logistic as LG
    h = FX.hyperplane(spark, sf)
    sd = LG.stds(h, SUMMARY_FEATURES)
    row = LG.loss_gradient_frame(h, SUMMARY_FEATURES, LR_BETA, LR_B, sd).first()
    loss, g, gi = LG.objective(row, np.array(LR_BETA), LR_REG, len(LR_BETA))
    vals = [("loss", loss)] + [(f"g{i}", float(x)) for i, x in enumerate(g)] + [("g_intercept", gi)]
    return spark.createDataFrame([(n, round(float(v), 6)) for n, v in vals], "name string, value double")


LR_COEF = [0.1, 5.0, 3.0]
LR_INTERCEPT = -3.0


@query("logistic_score", lambda: f"""
SELECT rk, {O.r6('1.0 / (1.0 + exp(-m))')} AS probability,
       CASE WHEN m > 0.0 THEN 1.0 ELSE 0.0 END AS prediction
FROM (SELECT rk, CAST({LR_INTERCEPT} AS DOUBLE) + l_quantity * CAST({LR_COEF[0]} AS DOUBLE)
      + l_discount * CAST({LR_COEF[1]} AS DOUBLE) + l_tax * CAST({LR_COEF[2]} AS DOUBLE) AS m
      FROM ({FX.hyperplane_sql()}))""")
def logistic_score(spark, sf):
    """Margin, sigmoid, threshold (t and the pair (1-t, t) agree)."""
    from grove.operators import logistic as LG
    h = FX.hyperplane(spark, sf)
    s = LG.score(h, SUMMARY_FEATURES, LR_COEF, LR_INTERCEPT, 0.5, thresholds=[0.5, 0.5])
    return s.select("rk", rnd("probability").alias("probability"), "prediction")


@query("logistic_warm_fit")
def logistic_warm_fit(spark, sf):
    """L-BFGS fit started from given coefficients; coefficients
    and the objective per iteration."""
    from grove.operators import logistic as LG
    h = FX.hyperplane(spark, sf)
    m = LG.fit(h, SUMMARY_FEATURES, reg=0.01, max_iter=50, init_coefficients=LR_COEF,
               init_intercept=LR_INTERCEPT)
    rows = [(f, float(c)) for f, c in zip(SUMMARY_FEATURES, m.coefficients)]
    rows.append(("intercept", m.intercept))
    rows += [(f"objective_{i}", float(v)) for i, v in enumerate(m.objective_history)]
    return spark.createDataFrame(rows, "name string, value double")


# ====================================================== curves
def _curve_sql(select: str) -> str:
    return _pred_sql(_forest_sql_dict(), 3) + f""",
    per AS (SELECT round(p1, 6) AS s, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
                   sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg FROM pred GROUP BY 1),
    rk AS (SELECT *, row_number() OVER (ORDER BY s DESC) AS rnk, count(*) OVER () AS nd FROM per),
    bins AS (SELECT CASE WHEN nd // 100 >= 2 THEN (rnk - 1) // (nd // 100) ELSE rnk - 1 END AS bin,
                    max(s) AS threshold, sum(pos) AS pos, sum(neg) AS neg FROM rk GROUP BY 1),
    cum AS (SELECT *, sum(pos) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) AS cum_pos,
                      sum(neg) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) AS cum_neg,
                      sum(pos) OVER () AS total_pos, sum(neg) OVER () AS total_neg FROM bins),
    roc AS (SELECT CAST(0 AS BIGINT) AS point, 0.0 AS fpr, 0.0 AS tpr
            UNION ALL SELECT bin + 1, cum_neg / total_neg, cum_pos / total_pos FROM cum
            UNION ALL SELECT max(bin) + 2, 1.0, 1.0 FROM cum)
    {select}"""


def _bins(spark, sf):
    from grove.operators.evaluate import score_bins
    # without the row key, whose hash of five columns costs more than the scoring
    s = _forest_model(spark, sf).transform(FX.hyperplane(spark, sf), keep=["label"])
    return score_bins(s.select("label", F.round(F.col("probability")[1], 6).alias("score")))


@query("roc_curve", lambda: _curve_sql(
    f"SELECT point, {O.r6('fpr')} AS fpr, {O.r6('tpr')} AS tpr FROM roc"))
def roc_curve(spark, sf):
    """ROC points of the forest's class-1 probability (100 bins)."""
    from grove.operators.evaluate import roc_curve as rc
    r = rc(_bins(spark, sf))
    return r.select("point", rnd("fpr").alias("fpr"), rnd("tpr").alias("tpr"))


@query("auc", lambda: _curve_sql(
    f"SELECT {O.r6('sum((fpr - pf) * (tpr + pt) / 2.0)')} AS auc FROM (SELECT *, lag(fpr) OVER "
    f"(ORDER BY point) AS pf, lag(tpr) OVER (ORDER BY point) AS pt FROM roc)"))
def auc(spark, sf):
    """Trapezoid area under the ROC curve."""
    from grove.operators.evaluate import auc as a, roc_curve as rc
    return a(rc(_bins(spark, sf))).select(rnd("auc").alias("auc"))


@query("pr_curve", lambda: _curve_sql(
    f"SELECT CAST(0 AS BIGINT) AS point, 0.0 AS recall, 1.0 AS precision UNION ALL "
    f"SELECT bin + 1, {O.r6('cum_pos / total_pos')}, {O.r6('cum_pos / (cum_pos + cum_neg)')} FROM cum"))
def pr_curve(spark, sf):
    """Precision-recall points, (0, 1) first."""
    from grove.operators.evaluate import pr_curve as pc
    r = pc(_bins(spark, sf))
    return r.select("point", rnd("recall").alias("recall"), rnd("precision").alias("precision"))


@query("metrics_by_threshold", lambda: _curve_sql(
    f"SELECT threshold, {O.r6('p')} AS precision, {O.r6('r')} AS recall, "
    f"{O.r6('CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END')} AS f_measure FROM "
    f"(SELECT threshold, cum_pos / (cum_pos + cum_neg) AS p, cum_pos / total_pos AS r FROM cum)"))
def metrics_by_threshold(spark, sf):
    """Precision, recall, F1 per threshold."""
    from grove.operators.evaluate import metrics_by_threshold as mt
    r = mt(_bins(spark, sf))
    return r.select("threshold", rnd("precision").alias("precision"), rnd("recall").alias("recall"),
                    rnd("f_measure").alias("f_measure"))


# ============================================================ update (I)
FATE_R, FATE_P = 0.3, 0.4


def _fates_sql():
    from grove.operators.sampling import SEED_FATE
    i1, u1 = O.hash_u("f1", SEED_FATE, ["1", "tree_id", "1"])
    i2, u2 = O.hash_u("f2", SEED_FATE, ["1", "tree_id", "2"])
    keep = 1 - FATE_R / (1 - FATE_P)
    return (f"SELECT CAST(tree_id AS INTEGER) AS tree_id, {O.r6('1.0 - 1.0 / 5')} AS weight, "
            f"CASE WHEN 1.0 - 1.0 / 5 < 0.1 THEN 'replace' WHEN {u1} < {FATE_P} THEN 'grow' "
            f"WHEN {u2} < {keep!r} THEN 'keep' ELSE 'replace' END AS fate "
            f"FROM (SELECT tree_id, {i1}, {i2} FROM range(5) t(tree_id))")


@query("tree_fates", _fates_sql)
def tree_fates(spark, sf):
    """Decayed weights and the fate each tree draws for version 1."""
    from grove.operators.forest import fate_column
    t = _forest_model(spark, sf).trees_df(spark)
    t = t.withColumn("weight", F.col("weight") - 1.0 / 5)
    return t.select("tree_id", rnd("weight").alias("weight"),
                    fate_column(F.col("weight"), F.col("max_depth"), F.col("tree_id"), 1, FATE_R,
                                FATE_P, 0).alias("fate"))


def _half_sql(b: int) -> str:
    """Batch ``b`` of two equal ones of the hyperplane fixture."""
    items, u = O.hash_u("hh", B.SEED_BATCH, ["rk"])
    return (f"SELECT * FROM (SELECT *, {items} FROM ({FX.hyperplane_sql()})) "
            f"WHERE CAST(least(floor({u} * 2.0), 1) AS INTEGER) = {b}")


GROWN = dict(num_trees=5, max_depth=2, seed=0)


def _update_sql():
    q = O.grown_forest_sql(_half_sql(0), _half_sql(1), FX.HYPER_FEATURES, subset_k=2, **GROWN)
    return _nodes_sql({"with": q}).rpartition("FROM nodes")[0] + "FROM grown"


def _updated(spark, sf):
    from grove.operators.forest import IncrementalForest
    from grove.operators.growth import ForestParams
    h = B.split_batches(FX.hyperplane(spark, sf), 2, holdout=False)
    est = IncrementalForest(FX.hyperplane_spec(), ForestParams(**GROWN, regrow_prop=0.0, incremental_prop=1.0))
    return est.update(est.fit(h.where(F.col("batch") == 0)), h.where(F.col("batch") == 1))


@query("update_forest", _update_sql)
def update_forest(spark, sf):
    """Fit on one half, grow every tree with the other; leaf statistics
    merged; returns the new version's nodes."""
    return _nodes_out(_updated(spark, sf), spark)


def _aged_sql(trees: str, version: int, num_trees: int, max_depth: int) -> str:
    """Trees after the update to ``version`` by FATE_R and FATE_P: decayed, then
    grown, kept or replaced."""
    from grove.operators.sampling import SEED_FATE
    i1, u1 = O.hash_u("f1", SEED_FATE, [str(version), "tree_id", "1"])
    i2, u2 = O.hash_u("f2", SEED_FATE, [str(version), "tree_id", "2"])
    keep = 1 - FATE_R / (1 - FATE_P)
    fate = (f"CASE WHEN weight - CAST(1 AS DOUBLE) / {num_trees} < 0.1 OR max_depth = 30 THEN 'replaced' "
            f"WHEN {u1} < {FATE_P} THEN 'grown' WHEN {u2} < {keep!r} THEN 'kept' ELSE 'replaced' END")
    return f"""SELECT tree_id, CASE fate WHEN 'kept' THEN weight - CAST(1 AS DOUBLE) / {num_trees} ELSE CAST(1 AS DOUBLE) END AS weight,
  CAST(CASE fate WHEN 'grown' THEN least(max_depth + 1, 30) WHEN 'replaced' THEN {max_depth} ELSE max_depth END AS INTEGER) AS max_depth,
  CAST(CASE fate WHEN 'replaced' THEN {version} ELSE born_version END AS INTEGER) AS born_version,
  CAST(CASE fate WHEN 'kept' THEN stats_version ELSE {version} END AS INTEGER) AS stats_version, fate AS origin
FROM (SELECT *, {fate} AS fate FROM (SELECT *, {i1}, {i2} FROM ({trees})))"""


def _new_trees_sql(first: int, count: int, max_depth: int, version: int, origin: str) -> str:
    return (f"SELECT CAST(tree_id AS INTEGER) AS tree_id, CAST(1 AS DOUBLE) AS weight, {max_depth} AS max_depth, "
            f"{version} AS born_version, {version} AS stats_version, '{origin}' AS origin "
            f"FROM range({first}, {first + count}) t(tree_id)")


@query("update_fates", lambda: _aged_sql(_new_trees_sql(0, 5, 3, 0, "fit"), 1, 5, 3))
def update_fates(spark, sf):
    """The same update with trees grown, kept and replaced; returns the
    new version's trees."""
    from grove.operators.forest import IncrementalForest
    from grove.operators.growth import ForestParams
    h = B.split_batches(FX.hyperplane(spark, sf), 2, holdout=False)
    est = IncrementalForest(FX.hyperplane_spec(), ForestParams(
        num_trees=5, max_depth=3, seed=0, regrow_prop=FATE_R, incremental_prop=FATE_P))
    m0 = est.fit(h.where(F.col("batch") == 0))
    m1 = est.update(m0, h.where(F.col("batch") == 1))
    return m1.trees_df(spark)


@query("add_trees", lambda: f"{_new_trees_sql(0, 3, 3, 0, 'fit')} UNION ALL {_new_trees_sql(3, 2, 3, 1, 'added')}")
def add_trees(spark, sf):
    """Warm start - two more trees on the model's frozen splits."""
    from grove.operators.forest import IncrementalForest
    from grove.operators.growth import ForestParams
    h = B.split_batches(FX.hyperplane(spark, sf), 2, holdout=False)
    est = IncrementalForest(FX.hyperplane_spec(), ForestParams(num_trees=3, max_depth=3, seed=0))
    m = est.add_trees(est.fit(h.where(F.col("batch") == 0)), h.where(F.col("batch") == 1), 2)
    return m.trees_df(spark)


def _leaf_ids_sql():
    fs = _forest_sql_dict()
    return (f"{fs['with']} SELECT rk, CAST(tree_id AS INTEGER) AS tree_id, node_id FROM "
            f"({O.route_sql('SELECT * FROM binned', 'SELECT * FROM nodes', 3)})")


@query("leaf_ids", _leaf_ids_sql)
def leaf_ids(spark, sf):
    """A2: the leaf each row reaches in each tree."""
    from grove.operators.score import leaf_ids as li
    m = _forest_model(spark, sf)
    d = li(m, FX.hyperplane(spark, sf), keep=["rk"])
    return d.select("rk", F.posexplode("node_ids").alias("tree_id", "node_id"))


def _subset_sql():
    fs = _forest_sql_dict()
    items, u = O.hash_u("sh", B.SEED_SUBSET, ["0", "n.tree_id", "n.node_id", "f.feature"])
    return (f"{fs['with']} SELECT CAST(tree_id AS INTEGER) AS tree_id, node_id, "
            f"CAST(feature AS INTEGER) AS feature FROM (SELECT n.tree_id, n.node_id, f.feature, "
            f"{items}, row_number() OVER (PARTITION BY n.tree_id, n.node_id ORDER BY {u}, "
            f"f.feature) AS r FROM nodes n, range(4) f(feature) WHERE NOT n.is_leaf) WHERE r <= 2")


@query("feature_subset", _subset_sql)
def feature_subset(spark, sf):
    """The features each internal node of the forest considered."""
    m = _forest_model(spark, sf)
    nodes = m.nodes_df(spark).where(~F.col("is_leaf")).select("tree_id", "node_id")
    return B.feature_subsets(nodes, 4, 2)


# ====================================================== E2-E5, I13, S1-S5
#: Numbered batches of the prequential runs, and of each policy of the grid.
NUM_BATCHES, GRID_BATCHES = 15, 10


def _events_batches(spark, sf, n=NUM_BATCHES):
    return B.split_batches(FX.events(spark, sf), n)


@query("prequential_errors")
def prequential_errors(spark, sf):
    """E2 + S5: test on the next batch, then update with it."""
    from grove.operators.evaluate import prequential
    from grove.operators.forest import IncrementalForest
    from grove.operators.growth import ForestParams
    from grove.operators.evaluate import write_metrics
    from grove.session import new_work_path
    est = IncrementalForest(FX.events_spec(), ForestParams(num_trees=5, max_depth=3, seed=0))
    m = prequential(est.fit, est.update, lambda m, d: m.transform(d),
                    _events_batches(spark, sf), holdout=NUM_BATCHES)
    path = new_work_path(spark, "metrics")
    write_metrics(m, path)  # S5: the run's report, appended to a Parquet table
    return spark.read.parquet(path)


@query("policy_grid")
def policy_grid(spark, sf):
    """Hold-out error of all 66 (regrow, incremental) pairs on the 0.1 grid."""
    from grove.operators.evaluate import policy_grid as grid
    from grove.operators.forest import IncrementalForest
    from grove.operators.grid import grid_errors
    from grove.operators.growth import ForestParams
    est = IncrementalForest(FX.events_spec(), ForestParams(num_trees=3, max_depth=3, seed=0))
    return grid_errors(est, grid(0.1), _events_batches(spark, sf, GRID_BATCHES), holdout=GRID_BATCHES)


def _event_batch_sql(batches: int, which: str, holdout: bool) -> str:
    """Rows of the events fixture whose batch of ``batches`` is ``which`` (a condition on ``b``)."""
    items, u = O.hash_u("eb", B.SEED_BATCH, ["rk"])
    total = batches + (batches / 4.0 if holdout else 0.0)
    return (f"SELECT rk, label, {', '.join(FX.EVENT_FEATURES)} FROM (SELECT *, CAST(least(floor({u} * CAST({total!r} AS DOUBLE)), "
            f"{batches if holdout else batches - 1}) AS INTEGER) AS b FROM (SELECT *, {items} FROM ({FX.events_sql()}))) WHERE {which}")


def _kept_and_grown_sql():
    """Errors of two policies over two batches, the forests grown node by node in SQL."""
    n = len(FX.EVENT_FEATURES)
    parts = [_event_batch_sql(2, f"b = {b}", True) for b in range(3)]
    grown = O.grown_forest_sql(parts[0], parts[1], FX.EVENT_FEATURES, num_trees=3, max_depth=2, subset_k=2)
    binned = O.binned_sql(O.long_sql("SELECT * FROM base2", FX.EVENT_FEATURES), "SELECT * FROM th")

    def error(nodes: str, depth: int) -> str:
        share = [f"sum(CASE WHEN n.c0 + n.c1 > 0 THEN n.c{c} / (n.c0 + n.c1) ELSE 0 END)" for c in (0, 1)]
        return (f"SELECT 1.0 - avg(CASE WHEN b.label = v.p THEN 1.0 ELSE 0.0 END) AS error FROM (SELECT l.rk, "
                f"CASE WHEN {share[1]} > {share[0]} THEN 1.0 ELSE 0.0 END AS p FROM "
                f"({O.route_sql('SELECT * FROM binned2', f'SELECT * FROM {nodes}', depth)}) l "
                f"JOIN {nodes} n ON n.tree_id = l.tree_id AND n.node_id = l.node_id GROUP BY l.rk) v JOIN base2 b ON b.rk = v.rk")

    row = "SELECT CAST(0 AS DOUBLE) AS regrow, CAST({p} AS DOUBLE) AS incremental, {b} AS batch, {seen} AS rows_seen, {e} AS error FROM {f}"
    seen = ["(SELECT count(*) FROM base)", "(SELECT count(*) FROM base) + (SELECT count(*) FROM base1)"]
    rows = [row.format(p=p, b=b, seen=seen[b], e=O.r6("error"), f="grown_error" if (p, b) == (1, 1) else "first_error")
            for p in (0, 1) for b in (0, 1)]
    return (f"{grown},\nbase2 AS ({parts[2]}),\nbinned2 AS ({binned}),\nfirst_error AS ({error('nodes', 2)}),\n"
            f"grown_error AS ({error('grown', 3)})\n" + " UNION ALL ".join(rows))


@query("grid_kept_and_grown", _kept_and_grown_sql)
def grid_kept_and_grown(spark, sf):
    """Hold-out errors of the policies that keep and that grow every tree, over
    two batches of all events."""
    from grove.operators.forest import IncrementalForest
    from grove.operators.grid import grid_errors
    from grove.operators.growth import ForestParams
    est = IncrementalForest(FX.events_spec(), ForestParams(num_trees=3, max_depth=2, seed=0))
    out = grid_errors(est, [(0.0, 0.0), (0.0, 1.0)], B.split_batches(FX.events(spark, sf), 2), holdout=2)
    return out.drop("seconds").withColumn("error", rnd("error"))


def _stream_versions_sql():
    trees = [_new_trees_sql(0, 4, 2, 0, "fit")]
    for v in (1, 2):
        trees.append(_aged_sql(trees[-1], v, 4, 2))
    return " UNION ALL ".join(
        f"SELECT {v} AS version, CAST({v} AS INTEGER) AS batch, (SELECT count(*) FROM ({_event_batch_sql(3, f'b <= {v}', False)})) AS rows_seen, "
        f"tree_id, {O.r6('weight')} AS weight, max_depth, born_version, stats_version, origin FROM ({t})" for v, t in enumerate(trees))


@query("stream_versions", _stream_versions_sql)
def stream_versions(spark, sf):
    """I13 + S5: events as a stream of three micro-batches of several files, each tested
    before it trains; the trees of every version beside its metrics row."""
    from grove.operators.forest import IncrementalForest
    from grove.operators.growth import ForestParams
    from grove.session import new_work_path
    from grove.sources import model_store as MS
    from grove.streaming.stream import stream_updates, write_batches
    src, root = new_work_path(spark, "events-stream"), new_work_path(spark, "stream-model")
    write_batches(B.split_batches(FX.events(spark, sf), 3, holdout=False), src, "batch", [0, 1, 2], files=4)
    est = IncrementalForest(FX.events_spec(), ForestParams(num_trees=4, max_depth=2, seed=0, regrow_prop=FATE_R, incremental_prop=FATE_P))
    schema = spark.read.parquet(f"{src}/batch=0").schema
    stream_updates(spark, f"{src}/*", schema, est, root, files_per_batch=4, test_first=True)
    trees = reduce(DataFrame.unionByName, [
        spark.read.parquet(f"{MS.attempt_path(root, r['attempt'])}/trees").withColumn("version", F.lit(v))
        for v, r in MS.versions(spark, root).items()])
    return MS.metrics(spark, root).select("version", "batch", "rows_seen").join(trees, "version").withColumn("weight", rnd("weight"))


@query("control_errors")
def control_errors(spark, sf):
    """E5 + B5: built-in forest retrained on all batches seen so far."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from grove.sources.batches import BatchStore
    batches = BatchStore.write(_events_batches(spark, sf))
    va = VectorAssembler(inputCols=FX.EVENT_FEATURES, outputCol="features")
    test = va.transform(batches.read(NUM_BATCHES))
    rows = []
    for b in range(NUM_BATCHES):
        train = va.transform(batches.upto(b))
        m = RandomForestClassifier(numTrees=5, maxDepth=3, seed=0).fit(train)
        acc = m.transform(test).select(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
        rows.append((b, float(1 - acc)))
    return spark.createDataFrame(rows, "batch int, error double")


@query("stream_update", lambda: "SELECT tree_id, weight, 5 AS max_depth, 0 AS born_version, 2 AS stats_version, 'grown' AS origin, "
       f"2 AS version FROM ({_new_trees_sql(0, 3, 3, 0, 'fit')})")
def stream_update(spark, sf):
    """Events as a file stream of three batches; micro-batch 0 fits,
    the others update; returns the latest trees."""
    from grove.operators.forest import IncrementalForest
    from grove.operators.growth import ForestParams
    from grove.session import new_work_path
    from grove.streaming.stream import stream_updates, write_batches
    ev = B.split_batches(FX.events(spark, sf), 3, holdout=False)  # every event is streamed
    src = new_work_path(spark, "events-stream")
    write_batches(ev, src, "batch", [0, 1, 2])
    schema = spark.read.parquet(f"{src}/batch=0").schema
    est = IncrementalForest(FX.events_spec(), ForestParams(num_trees=3, max_depth=3, seed=0))
    st = stream_updates(spark, f"{src}/*", schema, est, new_work_path(spark, "stream-model"))
    return st["model"].trees_df(spark).withColumn("version", F.lit(st["model"].version))


@query("csv_scan", "SELECT event_id, event_type, value FROM events")
def csv_scan(spark, sf):
    """CSV with header and inferred types (written from the table)."""
    from grove.session import new_work_path
    from grove.sources.tables import read_csv
    path = new_work_path(spark, "events-csv")
    read_table(spark, sf, "events").select("event_id", "event_type", "value") \
        .write.option("header", True).csv(path)
    return read_csv(spark, path)


@query("numbered_batches", """
SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS batch,
       count(*) AS n FROM events GROUP BY 1""")
def numbered_batches(spark, sf):
    """One CSV folder per batch number; the number comes from the path."""
    from grove.session import new_work_path
    from grove.sources.tables import read_numbered
    path = new_work_path(spark, "events-numbered")
    e = FX.events(spark, sf).select("event_id", F.col("day").alias("d"), "value")
    e.write.option("header", True).partitionBy("d").csv(path)
    df = read_numbered(spark, f"{path}/*/*.csv", number_regex=r"d=(\d+)", from_path=True)
    return df.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@query("model_roundtrip", lambda: _nodes_sql(_forest_sql_dict()))
def model_roundtrip(spark, sf):
    """A saved forest loaded back gives the same nodes."""
    from grove.operators.forest import ForestModel
    m = _forest_model(spark, sf)
    return _nodes_out(ForestModel.load(spark, m.root, m.version), spark)


# ============================================= categorical splits
def _cat_root_best(spark, df, names, arity, num_classes):
    """Best root split of one unbagged tree over categorical features."""
    import numpy as np
    from grove.operators.growth import GrowState, best_splits, root_row
    splits = Q.Splits([np.array([]) for _ in names], list(arity),
                      [Q.is_unordered(a, num_classes, MAX_BINS) for a in arity])
    st = GrowState()
    st.nodes[(0, 1)] = root_row(0, Hg.channels(num_classes))
    fo = Hg.FlatForest.build(st.frame(), [0], max(arity))
    hist = Hg.histogram_pass(df, names, list(arity), splits, num_classes, fo, {0: 0}, [(0, 1)],
                             len(names), 1, 1.0, 0)
    b = best_splits(hist, list(arity), splits, num_classes, "gini", 1.0, 0.0).select("b.*")
    return b.select("feature", F.array_join(F.array_sort("left_categories"), ",").alias("left"),
                    rnd("gain").alias("gain"))


def _ordered_cat_sql():
    base = FX.categorical_sql()
    long = " UNION ALL ".join(
        f"SELECT label, {i} AS feature, CAST({c} AS INTEGER) AS bin FROM ({base})"
        for i, c in enumerate(["priority_idx", "segment_idx"]))
    g = I.gini_sql(["t0", "t1"])
    gl = I.gini_sql(["l0", "l1"])
    gr = I.gini_sql(["(t0 - l0)", "(t1 - l1)"])
    return f"""
    WITH h AS (SELECT feature, bin, sum(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END) AS s0,
                      sum(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END) AS s1 FROM ({long}) GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY s1 / (s0 + s1), bin) AS pos,
                 count(*) OVER (PARTITION BY feature) AS n,
                 sum(s0) OVER (PARTITION BY feature ORDER BY s1 / (s0 + s1), bin ROWS UNBOUNDED PRECEDING) AS l0,
                 sum(s1) OVER (PARTITION BY feature ORDER BY s1 / (s0 + s1), bin ROWS UNBOUNDED PRECEDING) AS l1,
                 sum(s0) OVER (PARTITION BY feature) AS t0, sum(s1) OVER (PARTITION BY feature) AS t1 FROM h),
    c AS (SELECT feature, pos, {g} - ((l0 + l1) / (t0 + t1)) * {gl}
                 - ((t0 + t1 - l0 - l1) / (t0 + t1)) * {gr} AS gain FROM o WHERE pos < n),
    b AS (SELECT * FROM c ORDER BY gain DESC, feature, pos LIMIT 1)
    SELECT b.feature, (SELECT string_agg(CAST(bin AS VARCHAR), ',' ORDER BY bin) FROM o
                       WHERE o.feature = b.feature AND o.pos <= b.pos) AS "left",
           {O.r6('b.gain')} AS gain FROM b"""


@query("best_split_ordered_cat", _ordered_cat_sql)
def best_split_ordered_cat(spark, sf):
    """T4: categories sorted by mean label, best prefix (root, two
    frequency-indexed string features)."""
    df, arity = FX.categorical(spark, sf)
    return _cat_root_best(spark, df, ["priority_idx", "segment_idx"], arity[:2], 2)


def _mc_cat(spark, sf):
    o = read_table(spark, sf, "orders")
    c = read_table(spark, sf, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    j, pi = P.string_index(j, "o_orderpriority", "label")
    j, si = P.string_index(j, "c_mktsegment", "segment_idx")
    j, ti = P.string_index(j, "o_orderstatus", "status_idx")
    j = H.with_row_key(j, [F.col("o_orderkey")])
    return j.select("rk", "label", "segment_idx", "status_idx"), [len(si.labels), len(ti.labels)], \
        len(pi.labels)


def _unordered_sql():
    join = "orders JOIN customer ON o_custkey = c_custkey"
    idx = lambda col: (f"(SELECT {col} AS v, row_number() OVER (ORDER BY count(*) DESC, {col}) - 1 "
                       f"AS idx FROM {join} GROUP BY {col})")
    base = (f"SELECT p.idx AS label, s.idx AS seg, t.idx AS st FROM {join} "
            f"JOIN {idx('o_orderpriority')} p ON o_orderpriority = p.v "
            f"JOIN {idx('c_mktsegment')} s ON c_mktsegment = s.v "
            f"JOIN {idx('o_orderstatus')} t ON o_orderstatus = t.v")
    K = 5
    cnt = ", ".join(f"sum(CASE WHEN label = {k} THEN 1.0 ELSE 0.0 END) AS s{k}" for k in range(K))
    L = [f"l{k}" for k in range(K)]
    T = [f"t{k}" for k in range(K)]
    R = [f"(t{k} - l{k})" for k in range(K)]
    nl, nt = "(" + " + ".join(L) + ")", "(" + " + ".join(T) + ")"
    gain = (f"{I.gini_sql(T)} - ({nl} / {nt}) * {I.gini_sql(L)} - (({nt} - {nl}) / {nt}) * "
            f"{I.gini_sql(R)}")
    return f"""
    WITH h AS (SELECT 0 AS feature, seg AS bin, {cnt} FROM ({base}) GROUP BY ALL
               UNION ALL SELECT 1 AS feature, st AS bin, {cnt} FROM ({base}) GROUP BY ALL),
    ar AS (SELECT feature, max(bin) + 1 AS arity FROM h GROUP BY feature),
    sub AS (SELECT feature, s AS split_idx, s + 1 AS mask FROM ar, range(CAST(pow(2, arity - 1) AS BIGINT) - 1) r(s)),
    tot AS (SELECT feature, {', '.join(f'sum(s{k}) AS t{k}' for k in range(K))} FROM h GROUP BY feature),
    lf AS (SELECT sub.feature, sub.split_idx, {', '.join(f'sum(h.s{k}) AS l{k}' for k in range(K))},
                  string_agg(CAST(h.bin AS VARCHAR), ',' ORDER BY h.bin) AS "left"
           FROM sub JOIN h ON h.feature = sub.feature AND (sub.mask >> h.bin) & 1 = 1 GROUP BY ALL),
    c AS (SELECT lf.*, tot.* EXCLUDE (feature), {gain} AS gain FROM lf JOIN tot USING (feature)
          WHERE {nl} >= 1 AND {nt} - {nl} >= 1)
    SELECT CAST(feature AS INTEGER) AS feature, "left", {O.r6('gain')} AS gain
    FROM c ORDER BY gain DESC, feature, split_idx LIMIT 1"""


@query("best_split_unordered_cat", _unordered_sql)
def best_split_unordered_cat(spark, sf):
    """T3 + Q5: five classes; low-arity categorical features split by
    category subsets (all 2^(arity-1) - 1 candidates)."""
    df, arity, k = _mc_cat(spark, sf)
    return _cat_root_best(spark, df, ["segment_idx", "status_idx"], arity, k)


def _mc_sql():
    cols = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {n}" for i, n in enumerate(FX.EMB_FEATURES))
    return (f"SELECT rk, CAST(label AS DOUBLE) AS label, {cols} FROM (SELECT *, "
            f"{FX._key_sql('rk', 0, ['vec_id'])} FROM embeddings)")


@query("multiclass_forest_nodes", lambda: _nodes_sql(O.forest_sql(
    _mc_sql(), FX.EMB_FEATURES, num_trees=3, max_depth=3, subset_k=8, num_classes=10), 10))
def multiclass_forest_nodes(spark, sf):
    """T9 with 10 classes and 64 features (8 per node): the wide fixture."""
    from grove.operators.features import FeatureSpec
    spec = FeatureSpec(list(FX.EMB_FEATURES), [0] * FX.EMB_DIM, "label", 10)
    m = _fit(spark, FX.multiclass(spark, sf), spec, num_trees=3, max_depth=3, seed=0)
    return _nodes_out(m, spark, 10)


@query("entropy_tree_nodes", lambda: _nodes_sql(O.forest_sql(
    FX.hyperplane_sql(), FX.HYPER_FEATURES, num_trees=1, max_depth=3, kind="entropy")))
def entropy_tree_nodes(spark, sf):
    """T10 with entropy impurity."""
    m = _fit(spark, FX.hyperplane(spark, sf), FX.hyperplane_spec(), num_trees=1, max_depth=3,
             seed=0, impurity="entropy")
    return _nodes_out(m, spark)


# ================================================= binning, regression score
def _stride_rows(spark, sf):
    return splits_stride(spark, sf).collect()  # bounded: features x (max_bins - 1)


@query("bin_continuous", lambda: (
    "SELECT rk, feature, bin FROM (" + O.binned_sql(
        O.long_sql(FX.hyperplane_sql(), FX.HYPER_FEATURES),
        O.thresholds_sql(O.long_sql(FX.hyperplane_sql(), FX.HYPER_FEATURES), MAX_BINS - 1)) + ")"))
def bin_continuous(spark, sf):
    """bin = number of thresholds below the value (Column expression)."""
    rows = _stride_rows(spark, sf)
    h = FX.hyperplane(spark, sf)
    th = {f: [r.threshold for r in rows if r.feature == f] for f in range(4)}
    arr = F.array(*[F.struct(F.lit(i).alias("feature"),
                             P.bin_continuous(F.col(c), th[i]).alias("bin"))
                    for i, c in enumerate(FX.HYPER_FEATURES)])
    return h.select("rk", F.explode(arr).alias("b")).select("rk", "b.feature", "b.bin")


@query("bin_categorical", f"""
SELECT o_orderkey, CAST(priority_idx AS INTEGER) AS bin FROM ({FX.categorical_sql()})""")
def bin_categorical(spark, sf):
    """Category index as bin, checked against the arity."""
    df, arity = FX.categorical(spark, sf)
    return df.select("o_orderkey", P.bin_categorical(F.col("priority_idx"), arity[0],
                                                     "priority_idx").alias("bin"))


def _reg_pred_sql():
    fs = O.forest_sql(_reg_base_sql(), REG_FEATURES, num_trees=1, max_depth=3, kind="variance",
                      num_classes=0)
    route = O.route_sql("SELECT * FROM binned", "SELECT * FROM nodes", 3)
    return (f"{fs['with']}, leafs AS ({route}) SELECT l.rk, "
            f"{O.r6('CASE WHEN n.c0 > 0 THEN n.c1 / n.c0 ELSE 0.0 END')} AS prediction "
            f"FROM leafs l JOIN nodes n ON n.tree_id = l.tree_id AND n.node_id = l.node_id")


@query("regression_predictions", _reg_pred_sql)
def regression_predictions(spark, sf):
    """M6: leaf mean of the variance tree."""
    from grove.operators.features import FeatureSpec
    spec = FeatureSpec(list(REG_FEATURES), [0] * 3, "label", 0)
    m = _fit(spark, _reg_df(spark, sf), spec, **REG)
    return m.transform(_reg_df(spark, sf), keep=["rk"]).select("rk", rnd("prediction").alias("prediction"))


def _tree_acc_sql():
    fs = _forest_sql_dict()
    route = O.route_sql("SELECT * FROM binned", "SELECT * FROM nodes", 3)
    return (f"{fs['with']}, leafs AS ({route}) SELECT CAST(l.tree_id AS INTEGER) AS tree_id, "
            f"{O.r6('avg(CASE WHEN (CASE WHEN n.c1 > n.c0 THEN 1.0 ELSE 0.0 END) = b.label THEN 1.0 ELSE 0.0 END)')} "
            f"AS accuracy, count(*) AS n FROM leafs l JOIN nodes n ON n.tree_id = l.tree_id AND "
            f"n.node_id = l.node_id JOIN base b ON b.rk = l.rk GROUP BY l.tree_id")


@query("tree_accuracy_weights", _tree_acc_sql)
def tree_accuracy_weights(spark, sf):
    """Per-tree accuracy on the batch, usable as tree weights."""
    from grove.operators.score import tree_accuracy
    m = _forest_model(spark, sf)
    return tree_accuracy(m, FX.hyperplane(spark, sf)).select("tree_id", rnd("accuracy").alias("accuracy"), "n")


@query("forest_shape", lambda: f"""{_forest_sql_dict()['with']}
    SELECT count(DISTINCT tree_id) AS num_trees, count(*) AS total_nodes,
           CAST(max(floor(log2(node_id))) AS INTEGER) AS max_depth,
           max(CASE WHEN NOT is_leaf THEN feature END) AS max_split_feature FROM nodes""")
def forest_shape(spark, sf):
    """M8 totals: trees, nodes, deepest level, highest split feature."""
    from grove.operators.inspect import forest_shape as fs
    return fs(_forest_model(spark, sf).nodes_df(spark))


@query("logistic_elastic_net")
def logistic_elastic_net(spark, sf):
    """Elastic-net penalty (proximal steps), penalty on original-scale
    coefficients (standardization off); coefficients and intercept."""
    from grove.operators import logistic as LG
    m = LG.fit(FX.hyperplane(spark, sf), SUMMARY_FEATURES, reg=0.01, elastic_net=0.5,
               standardization=False, max_iter=60)
    rows = [(f, float(c)) for f, c in zip(SUMMARY_FEATURES, m.coefficients)]
    return spark.createDataFrame(rows + [("intercept", m.intercept)], "name string, value double")


def _stage_reuse_sql():
    items, u = O.hash_u("bh", B.SEED_BATCH, ["rk"])
    return f"""
    WITH o AS (SELECT *, {FX._key_sql('rk', 0, ['o_orderkey'])} FROM orders),
    b AS (SELECT *, {items}, CAST(least(floor({u} * CAST(2.0 AS DOUBLE)), 1) AS INTEGER) AS batch FROM o),
    idx AS (SELECT o_orderpriority AS v, CAST(row_number() OVER (ORDER BY count(*) DESC,
            o_orderpriority) - 1 AS DOUBLE) AS idx FROM b WHERE batch = 0 GROUP BY o_orderpriority)
    SELECT o_orderkey, batch, coalesce(idx.idx, CAST((SELECT count(*) FROM idx) AS DOUBLE)) AS priority_idx
    FROM b LEFT JOIN idx ON b.o_orderpriority = idx.v"""


@query("prep_stage_reuse", _stage_reuse_sql)
def prep_stage_reuse(spark, sf):
    """P11 (decision D9): the label index is fitted on the first batch and
    reused for every later batch (unseen labels -> index n)."""
    o = H.with_row_key(read_table(spark, sf, "orders"), [F.col("o_orderkey")])
    o = B.split_batches(o, 2, holdout=False)
    idx = P.fit_string_index(o.where(F.col("batch") == 0), "o_orderpriority")
    out, _ = P.string_index(o, "o_orderpriority", "priority_idx", index=idx, handle_invalid="keep")
    return out.select("o_orderkey", "batch", "priority_idx")


@query("prequential_next_batch")
def prequential_next_batch(spark, sf):
    """Train through batch i, test on batch i + 1, then update."""
    from grove.operators.evaluate import prequential
    from grove.operators.forest import IncrementalForest
    from grove.operators.growth import ForestParams
    est = IncrementalForest(FX.events_spec(), ForestParams(num_trees=5, max_depth=3, seed=0,
                                                           incremental_prop=0.5, regrow_prop=0.3))
    batches = B.split_batches(FX.events(spark, sf), NUM_BATCHES, holdout=False)  # every event counts
    return prequential(est.fit, est.update, lambda m, d: m.transform(d), batches)
