"""Logistic regression with warm starts, L5-L10.

Loss and gradient at given coefficients are ONE Spark aggregate (sums of
Column expressions, partial aggregation on executors); only the feature-
length gradient comes back.  The optimiser - L-BFGS for the L2 objective -
is a few lines of NumPy on the driver around that job, which is what makes a
warm start from given coefficients possible (PySpark's estimator has none).

Objective (binary, standardised features x/std, no centring):
    sum_i w_i (log(1 + exp(m_i)) - y_i m_i) / sum_i w_i + reg/2 ||beta||^2
with m_i = beta . x_i/std + b; the intercept is not penalised.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grove.operators.stats import column_summary


def stds(df: DataFrame, features: Sequence[str], weight: str | None = None) -> np.ndarray:
    """Weighted unbiased standard deviations (bounded: one per feature)."""
    rows = {r["feature"]: r["variance"] for r in column_summary(df, features, weight).collect()}
    return np.sqrt(np.array([rows[f] for f in features], dtype=np.float64))


def _margin(features: Sequence[str], beta_std: np.ndarray, intercept: float, sd: np.ndarray) -> Column:
    m = F.lit(float(intercept))
    for f, b, s in zip(features, beta_std, sd):
        if s > 0 and b != 0:
            m = m + F.col(f).cast("double") * F.lit(float(b / s))
    return m


def loss_gradient_frame(df: DataFrame, features: Sequence[str], beta_std, intercept: float,
                        sd: np.ndarray, label: str = "label", weight: str | None = None) -> DataFrame:
    """One aggregate row: weight sum, weighted loss sum, gradient sums
    (standardised space) and the intercept gradient sum."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    y = F.col(label).cast("double")
    m = _margin(features, np.asarray(beta_std, float), intercept, sd)
    d = (df.select(w.alias("_w"), y.alias("_y"), m.alias("_m"),
                   *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)]))
    loss = F.when(F.col("_m") > 0, F.col("_m") + F.log1p(F.exp(-F.col("_m")))) \
        .otherwise(F.log1p(F.exp(F.col("_m")))) - F.col("_y") * F.col("_m")
    mult = F.col("_w") * (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_m"))) - F.col("_y"))
    aggs = [F.sum("_w").alias("wsum"), F.sum(F.col("_w") * loss).alias("lsum"),
            F.sum(mult).alias("g_intercept")]
    for i, s in enumerate(sd):
        scale = 1.0 / s if s > 0 else 0.0
        aggs.append(F.sum(mult * F.col(f"_x{i}") * F.lit(scale)).alias(f"g{i}"))
    return d.agg(*aggs)


def objective(row, beta_std: np.ndarray, reg: float, n: int, pen_scale=None):
    """Smooth part: mean loss + reg/2 sum (beta_j * s_j)^2, s_j = 1 when the
    penalty is on standardised coefficients, 1/std_j when it is on the
    original scale (standardization off)."""
    wsum = row["wsum"]
    s2 = np.ones(n) if pen_scale is None else np.asarray(pen_scale) ** 2
    loss = row["lsum"] / wsum + 0.5 * reg * float(np.dot(beta_std * beta_std, s2))
    g = np.array([row[f"g{i}"] for i in range(n)]) / wsum + reg * beta_std * s2
    return loss, g, row["g_intercept"] / wsum


class BlockEvaluator:
    """Loss and gradient over the batch cached as one NumPy block per
    partition; each evaluation is one ``treeReduce`` of per-partition
    partial sums (a few numbers per partition), so an optimiser iteration
    costs one light job instead of a freshly planned query."""

    def __init__(self, data: DataFrame, feats, label: str, weight: str | None, sd: np.ndarray):
        import pyarrow as pa
        cols = list(feats) + [label] + ([weight] if weight else [])
        nf = len(feats)
        has_w = weight is not None

        def pack(batches):  # one binary row per Arrow batch (~10k rows)
            for rb in batches:
                if rb.num_rows == 0:
                    continue
                a = np.column_stack([rb.column(i).to_numpy(zero_copy_only=False).astype(np.float64)
                                     for i in range(len(cols))])
                yield pa.RecordBatch.from_pydict({"a": pa.array([a.tobytes()], pa.binary()),
                                                  "rows": pa.array([rb.num_rows], pa.int64())})

        def unpack(r):
            a = np.frombuffer(r["a"], dtype=np.float64).reshape(r["rows"], len(cols))
            return (a[:, :nf], a[:, nf], a[:, nf + 1] if has_w else np.ones(len(a)))

        packed = data.select(*[F.col(c).cast("double") for c in cols]).mapInArrow(
            pack, "a binary, rows bigint")
        self.blocks = packed.rdd.map(unpack).persist(StorageLevel.MEMORY_AND_DISK)
        self.inv = np.where(sd > 0, 1.0 / np.where(sd > 0, sd, 1.0), 0.0)
        self.n = nf

    def __call__(self, beta_std: np.ndarray, intercept: float) -> dict:
        coef = np.asarray(beta_std, float) * self.inv  # raw-scale margin weights
        inv = self.inv
        b0 = float(intercept)

        def partial(block):
            X, y, w = block
            m = X @ coef + b0
            loss = np.where(m > 0, m + np.log1p(np.exp(-m)), np.log1p(np.exp(m))) - y * m
            mult = w * (1.0 / (1.0 + np.exp(-m)) - y)
            return np.concatenate([[w.sum(), (w * loss).sum(), mult.sum()], (mult @ X) * inv])

        tot = self.blocks.map(partial).treeReduce(lambda a, b: a + b, depth=2)
        out = {"wsum": tot[0], "lsum": tot[1], "g_intercept": tot[2]}
        out.update({f"g{i}": tot[3 + i] for i in range(self.n)})
        return out

    def close(self):
        self.blocks.unpersist()


@dataclass
class LogisticModel:
    features: list[str]
    coefficients: np.ndarray  # original scale
    intercept: float
    objective_history: list = field(default_factory=list)
    iterations: int = 0

    def margin(self) -> Column:
        m = F.lit(float(self.intercept))
        for f, c in zip(self.features, self.coefficients):
            m = m + F.col(f).cast("double") * F.lit(float(c))
        return m

    def transform(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        return score(df, self.features, self.coefficients, self.intercept, threshold)


def score(df: DataFrame, features: Sequence[str], coefficients, intercept: float,
          threshold: float = 0.5, thresholds: Sequence[float] | None = None) -> DataFrame:
    """Margin, probability 1/(1+exp(-m)), prediction p > t.  A pair of
    thresholds (1-t, t) must agree with t."""
    if thresholds is not None:
        if len(thresholds) != 2 or abs(thresholds[1] - threshold) > 1e-5 \
                or abs(thresholds[0] + thresholds[1] - 1.0) > 1e-5:
            raise ValueError("thresholds must be (1 - t, t) for the given threshold t")
    m = F.lit(float(intercept))
    for f, c in zip(features, coefficients):
        m = m + F.col(f).cast("double") * F.lit(float(c))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-m))
    # decided on the margin against logit(t), as the probability would be,
    # but without exp rounding at the boundary
    cut = math.log(threshold / (1.0 - threshold)) if 0 < threshold < 1 else (
        float("-inf") if threshold <= 0 else float("inf"))
    return df.withColumn("margin", m).withColumn("probability", p) \
             .withColumn("prediction", F.when(F.col("margin") > F.lit(cut), 1.0).otherwise(0.0))


def fit(df: DataFrame, features: Sequence[str], label: str = "label", weight: str | None = None,
        reg: float = 0.0, max_iter: int = 100, tol: float = 1e-6,
        init_coefficients=None, init_intercept: float | None = None,
        memory: int = 10, elastic_net: float = 0.0,
        standardization: bool = True, engine: str = "blocks", fit_intercept: bool = True) -> LogisticModel:
    """Warm start from given coefficients (original scale) and
    intercept, kept as given (decision D15); a cold start begins at zero
    with intercept log(n1/n0).  L6: penalty reg * ((1-a)/2 ||b||^2 + a ||b||_1)
    on the coefficients, not the intercept; on standardised coefficients, or
    on original-scale ones when ``standardization`` is off.  Pure L2 uses
    L-BFGS; with an L1 part, OWL-QN.  Without ``fit_intercept`` the intercept
    is 0 throughout.  Labels other than 0 and 1 raise."""
    feats = list(features)
    data = df.select(*[F.col(f).cast("double").alias(f) for f in feats],
                     F.col(label).cast("double").alias(label),
                     *([F.col(weight)] if weight else [])).persist(StorageLevel.MEMORY_AND_DISK)
    opened = []  # evaluators to close, also when a fit fails
    try:
        return _fit(data, feats, label, weight, reg, max_iter, tol, init_coefficients, init_intercept, memory,
                    elastic_net, standardization, engine, fit_intercept, opened)
    finally:
        data.unpersist()
        for e in opened:
            e.close()


def _fit(data, feats, label, weight, reg, max_iter, tol, init_coefficients, init_intercept, memory, elastic_net,
         standardization, engine, fit_intercept, opened) -> LogisticModel:
    sd = stds(data, feats, weight)
    n = len(feats)
    w = F.coalesce(F.col(weight), F.lit(1.0)) if weight else F.lit(1.0)
    y = F.col(label)
    r = data.agg(F.sum(w * y).alias("n1"), F.sum(w * (1 - y)).alias("n0"),
                 F.sum(F.when(y.isin(0.0, 1.0), 0).otherwise(1)).alias("bad")).first()
    if r["bad"]:
        raise ValueError(f"{r['bad']} labels are neither 0 nor 1")
    if init_coefficients is not None:
        beta = np.asarray(init_coefficients, float) * sd
        b0 = float(init_intercept or 0.0) if fit_intercept else 0.0
    else:
        beta = np.zeros(n)
        b0 = float(math.log(r["n1"] / r["n0"])) if r["n1"] and r["n0"] and fit_intercept else 0.0

    scale = None if standardization else np.where(sd > 0, 1.0 / np.where(sd > 0, sd, 1.0), 0.0)
    l2 = reg * (1.0 - elastic_net)
    l1 = reg * elastic_net

    blocks = BlockEvaluator(data, feats, label, weight, sd) if engine == "blocks" else None
    if blocks is not None:
        opened.append(blocks)

    def evaluate(x):
        if blocks is not None:
            row = blocks(x[:n], x[n])
        else:  # one DataFrame aggregate per evaluation
            row = loss_gradient_frame(data, feats, x[:n], x[n], sd, label, weight).first()
        loss, g, gi = objective(row, x[:n], l2, n, scale)
        return loss, np.append(g, gi if fit_intercept else 0.0)

    if l1 > 0:
        return _fit_owlqn(feats, sd, evaluate, np.append(beta, b0), l1, scale, max_iter, tol, memory)
    x = np.append(beta, b0)
    fx, gx = evaluate(x)
    hist = [fx]
    s_list, y_list = [], []
    it = 0
    for it in range(1, max_iter + 1):
        q = gx.copy()
        alphas = []
        for s, y in reversed(list(zip(s_list, y_list))):
            a = np.dot(s, q) / np.dot(y, s)
            alphas.append(a)
            q -= a * y
        if y_list:
            q *= np.dot(s_list[-1], y_list[-1]) / np.dot(y_list[-1], y_list[-1])
        for (s, y), a in zip(zip(s_list, y_list), reversed(alphas)):
            q += s * (a - np.dot(y, q) / np.dot(y, s))
        d = -q
        step = 1.0 if y_list else 1.0 / max(1.0, np.linalg.norm(gx))
        while True:  # Armijo backtracking
            xn = x + step * d
            fn, gn = evaluate(xn)
            if fn <= fx + 1e-4 * step * np.dot(gx, d) or step < 1e-10:
                break
            step *= 0.5
        s_vec, y_vec = xn - x, gn - gx
        if np.dot(s_vec, y_vec) > 1e-12:
            s_list.append(s_vec)
            y_list.append(y_vec)
            if len(s_list) > memory:
                s_list.pop(0)
                y_list.pop(0)
        x, gx = xn, gn
        rel = abs(fx - fn) / max(abs(fn), 1e-12)
        fx = fn
        hist.append(fx)
        if rel < tol or np.linalg.norm(gx) < tol:
            break
    coef = np.where(sd > 0, x[:n] / np.where(sd > 0, sd, 1.0), 0.0)
    return LogisticModel(feats, coef, float(x[n]), hist, it)


def _fit_owlqn(feats, sd, evaluate, x, l1, scale, max_iter, tol, memory=10) -> LogisticModel:
    """OWL-QN: L-BFGS on the smooth part, steered by the pseudo-gradient of
    the L1 term and kept inside the current orthant (intercept and
    zero-variance features unpenalised)."""
    n = len(feats)
    w = np.zeros(n + 1)
    w[:n] = l1 * (np.ones(n) if scale is None else scale)

    def pseudo(x, g):
        pg = g.copy()
        pos, neg, zero = x > 0, x < 0, x == 0
        pg[pos] += w[pos]
        pg[neg] -= w[neg]
        right, left = g + w, g - w
        z = np.where(right < 0, right, np.where(left > 0, left, 0.0))
        pg[zero] = z[zero]
        return pg

    def total(x, f):
        return f + float(np.dot(w, np.abs(x)))

    fx, gx = evaluate(x)
    hist = [total(x, fx)]
    s_list, y_list = [], []
    it = 0
    for it in range(1, max_iter + 1):
        pg = pseudo(x, gx)
        q = pg.copy()
        alphas = []
        for s_, y_ in reversed(list(zip(s_list, y_list))):
            a = np.dot(s_, q) / np.dot(y_, s_)
            alphas.append(a)
            q -= a * y_
        if y_list:
            q *= np.dot(s_list[-1], y_list[-1]) / np.dot(y_list[-1], y_list[-1])
        for (s_, y_), a in zip(zip(s_list, y_list), reversed(alphas)):
            q += s_ * (a - np.dot(y_, q) / np.dot(y_, s_))
        d = -q
        d[d * pg >= 0] = 0.0  # keep only descent components
        if not np.any(d):
            break
        orth = np.where(x != 0, np.sign(x), np.sign(-pg))
        step = 1.0 if y_list else 1.0 / max(1.0, np.linalg.norm(pg))
        while True:
            xn = x + step * d
            xn[:n][np.sign(xn[:n]) != orth[:n]] = 0.0  # stay in the orthant
            fn, gn = evaluate(xn)
            if total(xn, fn) <= hist[-1] + 1e-4 * np.dot(pg, xn - x) or step < 1e-12:
                break
            step *= 0.5
        s_vec, y_vec = xn - x, gn - gx
        if np.dot(s_vec, y_vec) > 1e-12:
            s_list.append(s_vec)
            y_list.append(y_vec)
            if len(s_list) > memory:
                s_list.pop(0)
                y_list.pop(0)
        obj = total(xn, fn)
        rel = abs(hist[-1] - obj) / max(abs(obj), 1e-12)
        x, fx, gx = xn, fn, gn
        hist.append(obj)
        if rel < tol:
            break
    coef = np.where(sd > 0, x[:n] / np.where(sd > 0, sd, 1.0), 0.0)
    return LogisticModel(list(feats), coef, float(x[n]), hist, it)


def predictions(df: DataFrame, model: LogisticModel, threshold: float = 0.5) -> DataFrame:
    """The training rows (or others) with margin, probability and prediction."""
    return score(df, model.features, model.coefficients, model.intercept, threshold)


def summary_frame(spark, model: LogisticModel) -> DataFrame:
    """Objective per iteration."""
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(model.objective_history)],
                                 "iteration int, objective double")


def fit_builtin(df: DataFrame, features: Sequence[str], label: str = "label", **params):
    """L7 cold fit with the built-in estimator (vectors only at this edge)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    v = VectorAssembler(inputCols=list(features), outputCol="features").transform(df)
    return LogisticRegression(featuresCol="features", labelCol=label, **params).fit(v)
