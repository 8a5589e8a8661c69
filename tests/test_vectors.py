"""Column functions against NumPy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from normlearn.functions import sql
from normlearn.functions import vectors as V

X = [3.0, -0.2, 0.0, -4.0]


def value(spark, column, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]) if columns else spark.range(1)
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("column", "expected"),
    [
        (lambda x: V.dot(x, V.vector([1, 2, 3, 4])), 3 - 0.4 - 16),
        (lambda x: V.dot_literal(x, [1, 2, 3, 4]), 3 - 0.4 - 16),
        (lambda x: V.squared_norm(x), 25.04),
        (lambda x: V.axpy(x, V.vector([1, 1, 2, 2]), 0.5), [3.5, 0.3, 1.0, -3.0]),
        (lambda x: V.scale(x, -2.0), [-6.0, 0.4, 0.0, 8.0]),
        (lambda x: V.ball_project(x, 1.0), list(np.array(X) / math.sqrt(25.04))),
        (lambda x: V.ball_project(x, 6.0), X),
        (lambda x: V.sparse_dot(x, F.array(F.lit(3), F.lit(0)), V.vector([0.5, 2])), 4.0),
        (lambda x: V.sparse_add(x, F.array(F.lit(1), F.lit(1), F.lit(3)), 0.1), [3.0, 0.0, 0.0, -3.9]),
        (lambda x: V.sparse_axpy(x, F.array(F.lit(1), F.lit(1)), V.vector([1, 2]), 0.1), [3.0, 0.1, 0.0, -4.0]),
        (lambda x: V.l1_shrink(x, 0.5), [2.5, 0.0, 0.0, -3.5]),
        (lambda x: V.l1_shrink_at(x, 0.5, F.array(F.lit(1), F.lit(3))), [3.0, 0.0, 0.0, -3.5]),
        (lambda x: V.l1_shrink_at(x, 0.5, F.array(F.lit(3), F.lit(0), F.lit(3), F.lit(3))), [2.5, -0.2, 0.0, -2.5]),
        (lambda x: V.l2_shrink(x, 1.0), [1.5, -0.1, 0.0, -2.0]),
        (lambda x: V.log_sum(F.get(x, 0), F.get(x, 1)), np.logaddexp(3.0, -0.2)),
        (lambda x: V.zeros(2), [0.0, 0.0]),
    ],
)
def test_kernels(spark, column, expected):
    found = spark.range(1).select(V.vector(X).alias("x")).select(column(F.col("x"))).first()[0]
    assert found == pytest.approx(expected, abs=1e-12)


def test_wide_products_agree(spark):
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=40), rng.normal(size=40)
    assert value(spark, V.dot_literal(V.vector(x), w.tolist())) == pytest.approx(x @ w)


def test_concat_takes_the_other_side_for_null(spark):
    a, none = V.vector([1, 2]), F.lit(None).cast("array<double>")
    assert value(spark, V.concat_array(a, a)) == [1, 2, 1, 2]
    assert value(spark, V.concat_array(none, a)) == [1, 2]
    assert value(spark, V.concat_array(a, none)) == [1, 2]
    assert value(spark, V.concat_array(none, none)) is None


@pytest.mark.parametrize("z", [-2000.0, -30.0, -1.0, 0.0, 1.0, 40.0, 2000.0])
def test_loss_is_finite_everywhere(spark, z):
    y, wx = F.lit(1.0), F.lit(z)
    assert value(spark, V.row_loss(y, wx)) == pytest.approx(np.logaddexp(0, -z))
    with np.errstate(over="ignore"):
        assert value(spark, V.gradient_scale(y, wx)) == pytest.approx(-1 / (1 + np.exp(z)))
        assert value(spark, V.sigmoid(wx)) == pytest.approx(1 / (1 + np.exp(-z)))


def test_unequal_lengths_and_nulls_give_null(spark):
    assert value(spark, V.dot(V.vector([1.0]), V.vector([1.0, 2.0]))) is None
    assert value(spark, V.sign_label(F.lit(None).cast("double"))) is None
    assert value(spark, V.sign_label(F.lit(0.0))) == -1


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql(
        "SELECT vec_dot(array(1D, 2D), array(3D, 4D)) a, sigma(0D) b, soft_plus(0D) c, row_loss(1D, -800D) d, "
        "row_gscale(1D, 0D) e, vec_zeros(2) f, vec_concat(null, array(1D)) g"
    ).first()
    assert (row.a, row.b, row.d, row.e, row.f, row.g) == (11, 0.5, 800, -0.5, [0, 0], [1])
    assert row.c == pytest.approx(math.log(2))
