"""The vector functions under SQL names, as temporary SQL functions of a session.

They are plain SQL expressions, which Catalyst inlines.  With them the gradient
queries can be written in SQL:

    SELECT sum(row_loss(label, vec_dot(vec_concat(xs, xr), array(0.1D, ...)))) FROM s JOIN r ON ...
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_V = "ARRAY<DOUBLE>"

FUNCTIONS = {
    "vec_concat": (f"a {_V}, b {_V}", _V, "CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE concat(a, b) END"),
    "vec_dot": (f"a {_V}, b {_V}", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)"),
    "sigma": ("v DOUBLE", "DOUBLE", "1D / (1D + exp(-v))"),
    "soft_plus": ("v DOUBLE", "DOUBLE", "greatest(v, 0D) + log1p(exp(-abs(v)))"),
    "row_loss": ("y DOUBLE, wx DOUBLE", "DOUBLE", "greatest(-y * wx, 0D) + log1p(exp(-abs(y * wx)))"),
    "row_gscale": ("y DOUBLE, wx DOUBLE", "DOUBLE", "-y / (1D + exp(y * wx))"),
    "vec_zeros": ("n INT", _V, "array_repeat(0D, n)"),
    # the names that Hive scripts use for the first two
    "ConcatArray": (f"a {_V}, b {_V}", _V, "CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE concat(a, b) END"),
    "FSQLPlus1": (f"w {_V}, x {_V}", "DOUBLE", "aggregate(zip_with(w, x, (a, b) -> a * b), 0D, (s, v) -> s + v)"),
}


def register(spark: SparkSession) -> None:
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
