"""Every plan gives the same loss and gradient, which are NumPy's."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from normlearn.functions import vectors as V
from normlearn.operators.data import Names, NormalizedData, normalized, validate
from normlearn.plans import gradient as G

from .reference_math import loss_gradient

S_SCHEMA = "sid long, label double, forkey long, xs array<double>"
R_SCHEMA = "rid long, xr array<double>"


def tables(spark, s, r, d_s, d_r):
    return normalized(spark.createDataFrame(s, S_SCHEMA), spark.createDataFrame(r, R_SCHEMA), d_s=d_s, d_r=d_r)


def results(data: NormalizedData, w):
    table = G.denormalized(data)
    for approach, k in (("m", None), ("s", None), ("sr", 3), ("f", None), ("fsql", None)):
        yield approach, G.collected(G.build(data, w, approach, table, k))
    keys = G.per_key(data, w)
    row = [*G.entity_sums(keys, data.d_s).first(), *G.attribute_sums(keys, data).first()]
    yield "pieces", (row[0], np.array(row[1:]))


def expected(s, r, w):
    vectors = dict(r)
    rows = [(y, [*x, *vectors[k]]) for _, y, k, x in s if k in vectors and None not in (y, k, x) and vectors[k] is not None]
    if not rows:
        return 0.0, np.zeros(len(w))
    y = np.array([1.0 if a > 0 else -1.0 for a, _ in rows])
    return loss_gradient(y, np.array([x for _, x in rows]), np.array(w))


TINY_S = [(1, 1.0, 1, [1.0, 2.0]), (2, -1.0, 1, [-1.0, 0.5]), (3, 1.0, 2, [0.0, -1.0]), (4, -1.0, 2, [3.0, 1.0])]
TINY_R = [(1, [0.5]), (2, [-2.0])]


def test_tiny_tables(spark):
    for _, (loss, g) in results(tables(spark, TINY_S, TINY_R, 2, 1), [0.5, -0.25, 1.0]):
        assert loss == pytest.approx(3.403771176050263, abs=1e-12)
        assert g == pytest.approx([0.116132607, 0.652088079, 1.107887981], abs=1e-9)


EDGES = {
    "key zero": ([(1, 1.0, 0, [1.0])], [(0, [2.0])]),
    "unmatched keys": ([(1, 1.0, 5, [1.0]), (2, -1.0, 1, [2.0])], [(1, [2.0]), (9, [1.0])]),
    "nulls": ([(1, None, 1, [1.0]), (2, 1.0, 1, None), (3, 1.0, None, [1.0]), (4, -1.0, 2, [1.0]), (5, 1.0, 1, [3.0])], [(1, [2.0]), (2, None)]),
    "labels 0 and 1": ([(1, 0.0, 1, [1.0]), (2, 1.0, 1, [-1.0])], [(1, [0.5])]),
    "large products": ([(1, 1.0, 1, [-9000.0]), (2, -1.0, 1, [9000.0])], [(1, [0.0])]),
    "one hot key": ([(i, (-1.0) ** i, 7, [i / 10]) for i in range(200)], [(7, [1.5]), (8, [0.0])]),
    "repeated rows": ([(1, 1.0, 1, [1.0])] * 5, [(1, [2.0])]),
    "no match": ([(1, 1.0, 1, [1.0])], [(2, [2.0])]),
    "empty": ([], []),
}


@pytest.mark.parametrize("name", EDGES)
def test_edges(spark, name):
    s, r = EDGES[name]
    w = [0.7, -0.3]
    loss, g = expected(s, r, w)
    for approach, (found, gradient) in results(tables(spark, s, r, 1, 1), w):
        assert found == pytest.approx(loss, rel=1e-12, abs=1e-12), approach
        assert gradient == pytest.approx(g, rel=1e-12, abs=1e-12), approach


def test_label_only_entities(spark):
    s, r = [(1, 1.0, 1, []), (2, -1.0, 2, [])], [(1, [2.0]), (2, [1.0])]
    loss, g = expected(s, r, [0.4])
    for _, (found, gradient) in results(tables(spark, s, r, 0, 1), [0.4]):
        assert (found, *gradient) == pytest.approx((loss, *g))


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10**6), st.integers(1, 4), st.integers(1, 20))
def test_random_tables(spark, seed, d_s, d_r):
    rng = np.random.default_rng(seed)
    r = [(k, rng.normal(size=d_r).tolist()) for k in range(12)]
    s = [(i, float(rng.choice([-1, 1])), int(rng.integers(-2, 14)), rng.normal(size=d_s).tolist()) for i in range(80)]
    w = rng.normal(size=d_s + d_r).tolist()
    loss, g = expected(s, r, w)
    for approach, (found, gradient) in results(tables(spark, s, r, d_s, d_r), w):
        assert found == pytest.approx(loss), approach
        assert gradient == pytest.approx(g, abs=1e-9), approach


def test_ladder_is_the_loss_along_a_direction(spark):
    data, w, p = tables(spark, TINY_S, TINY_R, 2, 1), [0.5, -0.25, 1.0], [1.0, -2.0, 0.5]
    steps = [1.0, 0.5, 0.25]
    for approach in ("s", "f"):
        found = list(G.ladder(G.products(data, [w, p], approach), steps).first())
        assert found == pytest.approx([expected(TINY_S, TINY_R, np.array(w) + a * np.array(p))[0] for a in steps])


def test_validation(spark):
    good = tables(spark, TINY_S, TINY_R, 2, 1)
    assert validate(good, strict_fk=True) == {"n_s": 4, "n_r": 2, "most_s": 2}
    with pytest.raises(ValueError, match="unique"):
        validate(tables(spark, TINY_S, [*TINY_R, (1, [3.0])], 2, 1))
    with pytest.raises(ValueError, match="lengths"):
        validate(tables(spark, [*TINY_S, (5, 1.0, 1, [1.0])], TINY_R, 2, 1))
    with pytest.raises(ValueError, match="not there"):
        validate(tables(spark, [*TINY_S, (5, 1.0, 77, [1.0, 1.0])], TINY_R, 2, 1), strict_fk=True)
    with pytest.raises(ValueError, match="coefficients"):
        G.build(good, [1.0], "s")


def test_names_and_widths_are_taken_from_the_tables(spark):
    s = spark.createDataFrame([(1, 1, 2, [1.0, 2.0], "extra")], "id int, y int, fk int, f array<double>, rid string")
    r = spark.createDataFrame([(2, [1.0], 5)], "k int, v array<double>, label int")
    data = normalized(s, r, Names(sid="id", label="y", forkey="fk", xs="f", rid="k", xr="v"))
    assert (data.d_s, data.d_r) == (2, 1)
    assert G.collected(G.stream(data, [0.0] * 3))[0] == pytest.approx(np.log(2))


def test_choice_of_the_approach(spark):
    narrow, wide = tables(spark, TINY_S, TINY_R, 2, 1), NormalizedData(None, None, 3, 64)
    assert G.choose(narrow, 10**6, 10) == "s"
    assert G.choose(wide, 10**6, 10) == "f"
    assert G.choose(wide, 10, 10) == "s"


def test_factorized_plan_joins_numbers_not_vectors(spark, sf_dir):
    from normlearn.queries import wide_data

    plan = G.per_key(wide_data(spark, sf_dir), [0.1] * 67)._jdf.queryExecution().optimizedPlan().toString()
    assert "xr" not in plan.split("Join")[0]


@pytest.mark.parametrize(("d_s", "d_r"), [(2, 40), (30, 2), (20, 20)])
@pytest.mark.parametrize("matched", [True, False])
def test_long_vectors(spark, d_s, d_r, matched):
    """Vectors beyond the length that is written out, and a join without rows."""
    rng = np.random.default_rng(d_s)
    r = [(k + (0 if matched else 100), rng.normal(size=d_r).tolist()) for k in range(5)]
    s = [(i, float(rng.choice([-1, 1])), int(rng.integers(0, 5)), rng.normal(size=d_s).tolist()) for i in range(30)]
    w = rng.normal(size=d_s + d_r).tolist()
    loss, g = expected(s, r, w)
    for approach, (found, gradient) in results(tables(spark, s, r, d_s, d_r), w):
        assert found == pytest.approx(loss), approach
        assert gradient == pytest.approx(g, abs=1e-9), approach


@pytest.mark.parametrize("approach", ["m", "s", "sr", "f", "fsql"])
def test_coefficients_outside_the_code(spark, approach):
    """The same sums as with written-out coefficients, from code that does not change with them."""
    s = spark.createDataFrame([(k, k % 2, k % 5, [0.1 * k, -0.3]) for k in range(40)], "sid long, label int, forkey long, xs array<double>")
    r = spark.createDataFrame([(k, [1.0, 0.2 * k, -0.5]) for k in range(4)], "rid long, xr array<double>")
    data = normalized(s, r, d_s=2, d_r=3)
    w = [0.3, -0.2, 0.5, 0.1, float(2**-40)]
    held = V.Coefficients.of(spark, w)
    assert len(held) == 5 and list(held) == w and list(held[1:4][1:]) == w[2:4]
    written, other = (G.collected(G.build(data, x, approach, k=3)) for x in (w, held))
    assert other[0] == pytest.approx(written[0]) and other[1] == pytest.approx(written[1])
    plan = G.build(data, held, approach, k=3)._jdf.queryExecution().executedPlan().toString()
    assert "Subquery" in plan and "* 0.3" not in plan
    steps = V.Coefficients.of(spark, [1.0, 0.5])
    rows = G.products(data, [held, held], approach)
    expected = G.ladder(G.products(data, [w, w], approach), [1.0, 0.5]).first()
    assert list(G.ladder(rows, steps).first()) == pytest.approx(list(expected))
