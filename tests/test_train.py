"""Training against one-step-at-a-time NumPy, MLlib's optimum and finite differences."""

from __future__ import annotations

import numpy as np
import pytest

from normlearn.operators import train as T
from normlearn.operators.data import normalized
from normlearn.plans import gradient as G
from normlearn.sources import datagen
from normlearn.sources.spec import TrainSpec

from .reference_math import descend, loss_gradient


@pytest.fixture(scope="module")
def generated(spark):
    data = normalized(datagen.entity_rows(spark, 10, 50, 4, 7), datagen.attribute_rows(spark, 50, 4, 7))
    rows = G.denormalized(data).collect()
    return data, np.array([r.label for r in rows]), np.array([r.x for r in rows])


def spec(algo, **more):
    return TrainSpec(**({"approach": "f", "algo": algo, "iters": 8, "w_init": 0.0, "stepsize": 1.0, "regularizer": 2.0} | more))


@pytest.mark.parametrize(("algo", "approach"), [("bgd", "f"), ("cgd", "s"), ("cgd", "sr"), ("lbfgs", "m"), ("cgd", "auto"), ("bgd", "fsql")])
def test_traces(generated, algo, approach):
    data, y, x = generated
    iters = 4 if algo == "cgd" else 8  # later CGD directions do not descend here, and end in rounding
    found = T.fit(data, spec(algo, approach=approach, srsplits=2, iters=iters))
    trace, w = descend(y, x, algo, iters, 1.0, 2.0)
    assert [t[3] for t in found.trace] == [t[2] for t in trace]
    assert np.array([(t[1], t[2], t[4]) for t in found.trace]) == pytest.approx(np.array([(a, b, d) for a, b, _, d in trace]), rel=1e-7)
    assert found.w == pytest.approx(w, abs=1e-7)


def test_flat_table_gives_the_same(generated):
    data, _, _ = generated
    flat = T.fit_rows(G.denormalized(data), spec("bgd", approach="t"))
    assert flat.w == pytest.approx(T.fit(data, spec("bgd")).w, abs=1e-9)


def test_optimum_is_mllibs(spark, generated):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    data, y, x = generated
    found = T.fit(data, spec("lbfgs", iters=40))
    rows = G.denormalized(data).select(((F.col("label") + 1) / 2).alias("label"), array_to_vector("x").alias("features"))
    model = LogisticRegression(regParam=2.0 / len(y), elasticNetParam=0.0, fitIntercept=False, standardization=False, tol=1e-9, maxIter=200).fit(rows)
    assert found.w == pytest.approx(model.coefficients.toArray(), abs=1e-3)
    assert loss_gradient(y, x, found.w, 2.0)[0] <= loss_gradient(y, x, model.coefficients.toArray(), 2.0)[0] + 1e-4


def test_gradient_matches_differences(generated):
    data, _, _ = generated
    w, h = np.linspace(-0.5, 0.5, data.d), 1e-5
    g = G.collected(G.factorized(data, w.tolist()))[1]
    for i in (0, 2, 3, 9):
        at = [G.collected(G.stream(data, (w + s * h * np.eye(data.d)[i]).tolist()))[0] for s in (1, -1)]
        assert (at[0] - at[1]) / (2 * h) == pytest.approx(g[i], abs=1e-5)


def test_tolerance_does_not_stop_the_first_iteration(generated):
    found = T.fit(generated[0], spec("cgd", iters=30, tolerance=1e-3))
    assert found.status == "tolerance" and 1 < len(found.trace) < 30


def test_compat_and_textbook_memory_differ_in_the_second_loop():
    s, t = np.array([1.0, 2.0]), np.array([2.0, 1.0])
    g = np.array([0.3, -0.7])
    assert not np.allclose(T._two_loops([(s, t)], g, True), T._two_loops([(s, t)], g, False))
    one = [(np.array([2.0]), np.array([4.0]))]
    assert T._two_loops(one, np.array([3.0]), False) == pytest.approx([-1.5])
    assert T._two_loops(one, np.array([3.0]), True) == pytest.approx([0.0])
    assert T._two_loops([(s, np.zeros(2))], g, False) == pytest.approx(-g)


def test_a_search_without_a_step_ends_with_a_status(generated):
    bad = T.Objective(lambda w: (1.0, np.ones(2)), lambda w, p, a: [2.0] * len(a), 0.0)
    found = T.minimize(bad, np.zeros(2), spec("bgd", max_trials=20))
    assert found.status == "line search failed" and found.w.tolist() == [0, 0]


def test_a_direction_that_does_not_descend_takes_no_step():
    flat = T.Objective(lambda w: (1.0, np.ones(2)), lambda w, p, a: [1.0 - 1e-16] * len(a), 0.0)  # equal but for rounding
    for slope in (1e-20, 0.0):
        with pytest.raises(T.SearchFailed):
            T.line_search(flat, 1.0, 1.0, slope, np.zeros(2), np.ones(2), 60)


def test_empty_join_is_stationary(spark):
    s = spark.createDataFrame([], "sid long, label double, forkey long, xs array<double>")
    r = spark.createDataFrame([], "rid long, xr array<double>")
    found = T.fit(normalized(s, r, d_s=1, d_r=1), spec("cgd"))
    assert found.status == "stationary" and found.trace[0][1] == 0


def test_prediction_and_saved_model(spark, generated, tmp_path):
    data, _, x = generated
    w = np.linspace(-1, 1, data.d)
    expected = sorted(1 / (1 + np.exp(-(x @ w))))
    for factorized in (True, False):
        assert sorted(r.p for r in T.predict(data, w, factorized).collect()) == pytest.approx(expected)
    T.FitResult(w).save(spark, f"{tmp_path}/model")
    assert [r.w for r in spark.read.parquet(f"{tmp_path}/model").orderBy("i").collect()] == pytest.approx(w.tolist())
