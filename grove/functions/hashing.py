"""Reproducible integer hashing, uniforms and Poisson weights.

Every random choice in grove (bagging, batches, feature subsets, tree fates,
extremely-randomised candidates, quantile samples) is a pure function of data
keys and a seed, so results do not depend on partitioning, row order or task
retries, and the same numbers can be produced by three backends:

* Spark ``Column`` expressions (JVM side, whole-stage codegen),
* SQL text that DuckDB runs for the oracle queries,
* NumPy inside Arrow batches (``mapInArrow`` steps).

All arithmetic is BIGINT and stays below 2**63.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the hash (any change changes every sampled result).
MODULUS = 2147483647  # 2**31 - 1
MUL_A = 48271
ADD_A = 11
MUL_B = 16807
ADD_B = 7
CHAIN = 65599
ROW_KEY_SEED = 7919


# ---------------------------------------------------------------- Column API
def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def mix(x) -> Column:
    """One mixing round: LCG step, then a quadratic step, modulo 2**31-1."""
    a = F.pmod(_c(x).cast("bigint"), F.lit(MODULUS))
    b = (a * MUL_A + ADD_A) % MODULUS
    # b * (b + MUL_B) + ADD_B  (mod M), with b written twice, not three times
    return (b * ((b + MUL_B) % MODULUS) + ADD_B) % MODULUS


def _mix_int(x: int) -> int:
    a = int(x) % MODULUS
    b = (a * MUL_A + ADD_A) % MODULUS
    return (b * ((b + MUL_B) % MODULUS) + ADD_B) % MODULUS


def chain(seed: int, *values) -> Column:
    """Hash of a list of BIGINT values.  The fold runs in ``aggregate`` so
    the running hash is a lambda variable: the expression does not grow
    with the number of values (no re-inlined sub-trees, no 64 KB methods)."""
    h0 = F.lit(_mix_int(seed)).cast("bigint")
    if not values:
        return h0
    if len(values) == 1:
        return mix(h0 * CHAIN + F.pmod(_c(values[0]).cast("bigint"), F.lit(MODULUS)))
    arr = F.array(*[_c(v).cast("bigint") for v in values])
    return F.aggregate(arr, h0, lambda h, x: mix(h * CHAIN + F.pmod(x, F.lit(MODULUS))))


def uniform(seed: int, *values) -> Column:
    """Uniform double in [0, 1) from a seed and key values."""
    return chain(seed, *values).cast("double") / float(MODULUS)


def with_row_key(df: DataFrame, key_cols: Sequence, out: str = "rk",
                 seed: int = 0) -> DataFrame:
    """Adds ``out``: a ~62-bit hash of the key columns (a table's unique
    key), two independent chains side by side, so distinct keys do not
    collide in practice.  Draws use ``out mod 2**31-1`` (the second chain)."""
    return df.withColumn(out, chain(seed + ROW_KEY_SEED, *key_cols) * MODULUS
                         + chain(seed, *key_cols))


def poisson_cdf(rate: float, tail: float = 1e-12) -> list[float]:
    """Cumulative Poisson(rate) probabilities P(X <= k), k = 0.. until the
    tail is below ``tail``.  Generated from the rate, not tabulated."""
    if rate <= 0:
        return [1.0]
    p = math.exp(-rate)
    cdf, acc, k = [], 0.0, 0
    while True:
        acc += p
        cdf.append(acc)
        # past the mean by many deviations the rest is below the tail or rounding
        if 1.0 - acc < tail or k > rate + 20 * math.sqrt(rate) + 40:
            break
        k += 1
        p *= rate / k
    return cdf


def poisson_weight(u: Column, rate: float = 1.0) -> Column:
    """Inverse-CDF Poisson draw from a uniform column."""
    cdf = poisson_cdf(rate)
    expr = F.lit(len(cdf) - 1)
    for k in range(len(cdf) - 2, -1, -1):
        expr = F.when(u < F.lit(cdf[k]), F.lit(k)).otherwise(expr)
    return expr.cast("int")


def bag_weight(u: Column, num_trees: int, rate: float = 1.0) -> Column:
    """Bag weight per (row, tree): Poisson(rate) when the forest has more than
    one tree (sampling with replacement), else Bernoulli(rate) (none if 1)."""
    if num_trees > 1:
        return poisson_weight(u, rate)
    if rate >= 1.0:
        return F.lit(1)
    return F.when(u < F.lit(float(rate)), F.lit(1)).otherwise(F.lit(0))


# ------------------------------------------------------------------ SQL text
def _fmt(x: float) -> str:
    """Double literal that both Spark SQL and DuckDB read as DOUBLE."""
    return format(float(x), ".17e")


def mix_sql(x: str) -> str:
    """SQL text for ``mix`` (the argument text appears twice)."""
    a = f"((CAST({x} AS BIGINT) % {MODULUS} + {MODULUS}) % {MODULUS})"
    b = f"(({a} * {MUL_A} + {ADD_A}) % {MODULUS})"
    return f"(({b} * (({b} + {MUL_B}) % {MODULUS}) + {ADD_B}) % {MODULUS})"


def chain_select_items(alias: str, seed: int, values: Sequence[str]) -> list[str]:
    """SELECT-list items computing the chain hash step by step with lateral
    column aliases (DuckDB and Spark SQL both resolve them).  The final
    value is ``alias``; helper columns are ``alias_s0``.. ."""
    items = [f"{mix_sql(str(int(seed)))} AS {alias}_s0"]
    prev = f"{alias}_s0"
    for i, v in enumerate(values, start=1):
        cur = f"{alias}_s{i}"
        items.append(
            f"{mix_sql(f'{prev} * {CHAIN} + ((CAST({v} AS BIGINT) % {MODULUS} + {MODULUS}) % {MODULUS})')} AS {cur}")
        prev = cur
    items.append(f"{prev} AS {alias}")
    return items


def row_key_sql(alias: str, seed: int, values: Sequence[str]) -> list[str]:
    """SELECT items for ``with_row_key``'s 62-bit key."""
    hi = chain_select_items(f"{alias}_hi", seed + ROW_KEY_SEED, values)
    lo = chain_select_items(f"{alias}_lo", seed, values)
    return hi + lo + [f"{alias}_hi * {MODULUS} + {alias}_lo AS {alias}"]


def uniform_sql(h: str) -> str:
    return f"(CAST({h} AS DOUBLE) / CAST({MODULUS} AS DOUBLE))"


def poisson_sql(u: str, rate: float = 1.0) -> str:
    cdf = poisson_cdf(rate)
    whens = " ".join(f"WHEN {u} < {_fmt(c)} THEN {k}" for k, c in enumerate(cdf[:-1]))
    return f"(CASE {whens} ELSE {len(cdf) - 1} END)"


def bag_weight_sql(u: str, num_trees: int, rate: float = 1.0) -> str:
    if num_trees > 1:
        return poisson_sql(u, rate)
    if rate >= 1.0:
        return "1"
    return f"(CASE WHEN {u} < {_fmt(rate)} THEN 1 ELSE 0 END)"


# --------------------------------------------------------------------- NumPy
def mix_np(x) -> np.ndarray:
    a = np.mod(np.asarray(x, dtype=np.int64), MODULUS)
    b = (a * MUL_A + ADD_A) % MODULUS
    return (b * ((b + MUL_B) % MODULUS) + ADD_B) % MODULUS


def chain_np(seed: int, *values) -> np.ndarray:
    h = mix_np(np.int64(seed))
    for v in values:
        h = mix_np(h * CHAIN + np.mod(np.asarray(v, dtype=np.int64), MODULUS))
    return h


def uniform_np(seed: int, *values) -> np.ndarray:
    return chain_np(seed, *values).astype(np.float64) / float(MODULUS)


def poisson_np(u: np.ndarray, rate: float = 1.0) -> np.ndarray:
    cdf = np.asarray(poisson_cdf(rate))
    # weight k is the first k with u < cdf[k]  (strict, as the CASE chain)
    return np.searchsorted(cdf[:-1], u, side="right").astype(np.int64)


def bag_weight_np(u: np.ndarray, num_trees: int, rate: float = 1.0) -> np.ndarray:
    if num_trees > 1:
        return poisson_np(u, rate)
    if rate >= 1.0:
        return np.ones(len(u), dtype=np.int64)
    return (u < rate).astype(np.int64)
