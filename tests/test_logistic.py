import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from grove.operators import logistic as LG
from grove.plans import fixtures as FX

F3 = ["l_quantity", "l_discount", "l_tax"]


def test_l2_fit_matches_builtin(spark):
    h = FX.hyperplane(spark, SMALL)
    m = LG.fit(h, F3, reg=0.01, standardization=False, tol=1e-10, max_iter=200)
    b = LG.fit_builtin(h, F3, regParam=0.01, standardization=False, tol=1e-10)
    assert np.allclose(m.coefficients, b.coefficients.toArray(), rtol=1e-3, atol=1e-4)
    assert abs(m.intercept - b.intercept) < 1e-3


def test_elastic_net_zeroes_like_builtin(spark):
    h = FX.hyperplane(spark, SMALL)
    m = LG.fit(h, F3, reg=0.01, elastic_net=0.5, standardization=False, tol=1e-10, max_iter=300)
    b = LG.fit_builtin(h, F3, regParam=0.01, elasticNetParam=0.5, standardization=False, tol=1e-10)
    bc = b.coefficients.toArray()
    assert ((m.coefficients == 0) == (bc == 0)).all()
    assert np.allclose(m.coefficients, bc, rtol=2e-2, atol=2e-3)


def test_warm_start_keeps_intercept_and_both_engines_agree(spark):
    h = FX.hyperplane(spark, SMALL)
    a = LG.fit(h, F3, reg=0.1, max_iter=3, init_coefficients=[0.1, 5.0, 3.0], init_intercept=-3.0)
    b = LG.fit(h, F3, reg=0.1, max_iter=3, init_coefficients=[0.1, 5.0, 3.0], init_intercept=-3.0,
               engine="sql")
    assert np.allclose(a.objective_history, b.objective_history, rtol=1e-9)
    assert a.objective_history[-1] < a.objective_history[0]


def test_fit_without_intercept_matches_builtin(spark):
    h = FX.hyperplane(spark, SMALL)
    m = LG.fit(h, F3, reg=0.01, standardization=False, tol=1e-10, max_iter=200, fit_intercept=False)
    b = LG.fit_builtin(h, F3, regParam=0.01, standardization=False, tol=1e-10, fitIntercept=False)
    assert m.intercept == 0.0
    assert np.allclose(m.coefficients, b.coefficients.toArray(), rtol=1e-3, atol=1e-4)


def test_invalid_labels_raise_and_leave_no_cache(spark):
    h = FX.hyperplane(spark, SMALL).withColumn("label", F.col("label") * 2)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    with pytest.raises(ValueError, match="neither 0 nor 1"):
        LG.fit(h, F3)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_training_summary(spark):
    h = FX.hyperplane(spark, SMALL)
    m = LG.fit(h, F3, reg=0.01)
    history = [r.objective for r in LG.summary_frame(spark, m).orderBy("iteration").collect()]
    assert history == sorted(history, reverse=True) and len(history) == m.iterations + 1
    p = LG.predictions(h, m)
    assert p.count() == h.count() and p.where("probability between 0 and 1").count() == h.count()
