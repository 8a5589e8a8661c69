"""Vector and scalar functions as Column expressions; no Python runs on executors.

Vectors are ``array<double>`` without null elements.  A null argument gives null
unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Up to this many terms a product with known coefficients is written out; beyond,
#: generated code grows faster than it helps and a higher-order function is used.
UNROLL = 16


def vector(values: Sequence[float]) -> Column:
    """A literal vector."""
    if not len(values):
        return F.array().cast("array<double>")
    return F.array(*[F.lit(float(v)) for v in values])


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    """The inner product; null for vectors of different lengths."""
    return total(F.zip_with(x, y, lambda a, b: a * b))


class Coefficients(Sequence[float]):
    """Coefficients that a plan takes from a table of one row, and not from its own text.

    Passes that differ in nothing else share their generated code, which is compiled once.
    """

    def __init__(self, values: Sequence[float], row: Column, first: int = 0) -> None:
        self.values, self.row, self.first = values, row, first

    @classmethod
    def of(cls, spark: SparkSession, values: Sequence[float]) -> Coefficients:
        table = spark.sql("SELECT w FROM VALUES (:w) AS t(w)", args={"w": vector(values)})
        return cls(values, table.scalar())

    def __len__(self) -> int:
        return len(self.values)

    def __getitem__(self, at):
        if isinstance(at, slice):
            return Coefficients(self.values[at], self.row, self.first + at.indices(len(self))[0])
        return self.values[at]

    def column(self, i: int) -> Column:
        return F.get(self.row, self.first + i)


def coefficient(w: Sequence[float], i: int) -> Column:
    return w.column(i) if isinstance(w, Coefficients) else F.lit(float(w[i]))


def dot_literal(x: Column, w: Sequence[float], of: int | None = None) -> Column:
    """The inner product with known coefficients; ``of`` is the length of the whole product it is a part of.

    Written-out coefficients are part of the generated code, which is compiled anew
    for others unless they are ``Coefficients``; in a wide pass it is too long.
    """
    if max(len(w), of or 0) > UNROLL:
        return dot(x, vector(w))
    out = F.lit(0.0)
    for i in range(len(w)):
        out = out + F.get(x, i) * coefficient(w, i)
    return out


def concat_array(a: Column, b: Column) -> Column:
    """``a`` followed by ``b``; where one is null, the other."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.concat(a, b))


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def softplus(z: Column) -> Column:
    """log(1 + exp(z)), finite for any finite z."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def sign_label(label: Column) -> Column:
    """Labels -1 and 1; 0 counts as -1."""
    return F.when(label.isNotNull(), F.when(label > 0, 1.0).otherwise(-1.0))


def row_loss(y: Column, wx: Column) -> Column:
    return softplus(-y * wx)


def gradient_scale(y: Column, wx: Column) -> Column:
    """What a row's vector is multiplied with in the gradient of the loss."""
    return -y / (F.lit(1.0) + F.exp(y * wx))


def axpy(x: Column, y: Column, c) -> Column:
    """x + c * y"""
    return F.zip_with(x, y, lambda a, b: a + F.lit(c) * b)


def scale(x: Column, c) -> Column:
    return F.transform(x, lambda v: v * F.lit(c))


def squared_norm(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)


def ball_project(x: Column, radius: float) -> Column:
    """x, or the nearest vector of that norm where x is longer."""
    n = squared_norm(x)
    return F.when(n > radius * radius, F.transform(x, lambda v: v * (F.lit(float(radius)) / F.sqrt(n)))).otherwise(x)


def sparse_dot(x: Column, index: Column, values: Column) -> Column:
    """Sum of x[index_i] * values_i; indices from 0, outside x they make it null."""
    return total(F.zip_with(index, values, lambda k, v: F.get(x, k) * v))


def sparse_add(x: Column, index: Column, c) -> Column:
    """x with c added at each index, as often as it is listed."""
    return F.transform(x, lambda v, i: v + F.lit(c) * F.size(F.filter(index, lambda k: k == i)))


def sparse_axpy(x: Column, index: Column, values: Column, c) -> Column:
    """x with c * values_i added at index_i."""
    pairs = F.arrays_zip(index.alias("k"), values.alias("v"))
    at = lambda i: F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.when(p["k"] == i, p["v"]).otherwise(0.0))
    return F.transform(x, lambda e, i: e + F.lit(c) * at(i))


def _soft(v: Column, u: float | Column) -> Column:
    u = u if isinstance(u, Column) else F.lit(float(u))
    return F.when(v > u, v - u).when(v < -u, v + u).otherwise(F.lit(0.0))


def l1_shrink(x: Column, u: float) -> Column:
    """Soft threshold of each element."""
    return F.transform(x, lambda v: _soft(v, u))


def l1_shrink_at(x: Column, u: float, index: Column) -> Column:
    """Soft threshold of the listed elements, as often as each is listed: thresholds one after the other add up."""

    def shrunk(v: Column, i: Column) -> Column:
        times = F.size(F.filter(index, lambda k: k == i))
        return F.when(times > 0, _soft(v, times * F.lit(float(u)))).otherwise(v)

    return F.transform(x, shrunk)


def l2_shrink(x: Column, u: float) -> Column:
    return F.transform(x, lambda v: v / F.lit(1.0 + u))


def log_sum(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b))"""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))
