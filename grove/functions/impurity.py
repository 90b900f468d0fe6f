"""Impurity, gain and leaf prediction as Column expressions
and the same formulas as SQL text for the oracle queries.

Classification statistics are per-class weights; regression statistics are
(count, sum, sum of squares).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(cs: Sequence[Column]) -> Column:
    t = cs[0]
    for c in cs[1:]:
        t = t + c
    return t


def gini(cs: Sequence[Column]) -> Column:
    """1 - sum p^2; 0 when empty."""
    t = total(cs)
    sq = None
    for c in cs:
        term = (c / t) * (c / t)
        sq = term if sq is None else sq + term
    return F.when(t == 0, F.lit(0.0)).otherwise(F.lit(1.0) - sq)


def entropy(cs: Sequence[Column]) -> Column:
    """-sum p log2 p; 0 when empty."""
    t = total(cs)
    acc = None
    for c in cs:
        p = c / t
        term = F.when(c == 0, F.lit(0.0)).otherwise(-p * F.log2(p))
        acc = term if acc is None else acc + term
    return F.when(t == 0, F.lit(0.0)).otherwise(acc)


def variance(n: Column, s: Column, s2: Column) -> Column:
    """(sumSq - sum^2/n) / n; 0 when empty."""
    return F.when(n == 0, F.lit(0.0)).otherwise((s2 - (s * s) / n) / n)


def impurity(kind: str, cs: Sequence[Column]) -> Column:
    kind = kind.lower()
    if kind == "gini":
        return gini(cs)
    if kind == "entropy":
        return entropy(cs)
    if kind == "variance":
        return variance(cs[0], cs[1], cs[2])
    raise ValueError(f"unknown impurity {kind}")


def count_of(kind: str, cs: Sequence[Column]) -> Column:
    return cs[0] if kind.lower() == "variance" else total(cs)


def predict(kind: str, cs: Sequence[Column]) -> Column:
    """A10: majority class (first on ties) or mean."""
    if kind.lower() == "variance":
        return F.when(cs[0] == 0, F.lit(0.0)).otherwise(cs[1] / cs[0])
    arr = F.array(*cs)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("double")


# ------------------------------------------------------------------ SQL text
def gini_sql(cs: Sequence[str]) -> str:
    t = "(" + " + ".join(cs) + ")"
    sq = " + ".join(f"(({c}) / {t}) * (({c}) / {t})" for c in cs)
    return f"(CASE WHEN {t} = 0 THEN 0.0 ELSE 1.0 - ({sq}) END)"


def entropy_sql(cs: Sequence[str]) -> str:
    t = "(" + " + ".join(cs) + ")"
    terms = " + ".join(f"(CASE WHEN ({c}) = 0 THEN 0.0 ELSE -(({c}) / {t}) * log2(({c}) / {t}) END)"
                       for c in cs)
    return f"(CASE WHEN {t} = 0 THEN 0.0 ELSE {terms} END)"


def variance_sql(n: str, s: str, s2: str) -> str:
    return f"(CASE WHEN ({n}) = 0 THEN 0.0 ELSE (({s2}) - (({s}) * ({s})) / ({n})) / ({n}) END)"


def impurity_sql(kind: str, cs: Sequence[str]) -> str:
    kind = kind.lower()
    if kind == "gini":
        return gini_sql(cs)
    if kind == "entropy":
        return entropy_sql(cs)
    return variance_sql(cs[0], cs[1], cs[2])
