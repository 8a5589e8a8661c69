"""Synthetic entity and attribute tables.

A random unit vector w scales all features.  Every attribute row has normal
features; each of its ``ratio`` entity rows has a label of -1 or 1 and normal
features around the label (``shift``), or around 0.  All random numbers come from
the MD5 of a row's key and a number of the column, so rows are made in parallel,
the same arguments give the same table however it is partitioned, and any engine
with that function makes the same one.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normlearn.sources import tables

DIGITS = 12  # hexadecimal, of a uniform number


def _of_text(text: str) -> float:
    return (int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16) + 0.5) / 16**DIGITS


def coefficients(d: int, seed: int) -> np.ndarray:
    """A unit vector of uniform directions in the cube."""
    w = np.array([_of_text(f"w:{seed}:{i}") - 0.5 for i in range(d)])
    return w / np.linalg.norm(w)


def _uniforms(table: str, key: str, seed: int, column: int) -> tuple[Column, Column]:
    """Two numbers in (0, 1), from the digest of table, seed, column and the row's key."""
    digest = F.md5(F.concat(F.lit(f"{table}:{seed}:{column}:"), F.col(key).cast("string")))
    part = lambda at: (F.conv(F.substring(digest, at, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)
    return part(1), part(1 + DIGITS)


def _normal(table: str, key: str, seed: int, column: int, deviation: float) -> Column:
    u, v = _uniforms(table, key, seed, column)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2 * np.pi * v) * F.lit(float(deviation))


def attribute_rows(spark: SparkSession, n: int, d_s: int, d_r: int, deviation: float = 1.0, seed: int = 1) -> DataFrame:
    """rid from 1 to n, xr of ``d_r`` features.  ``d_s`` counts the label too."""
    w = coefficients(d_s + d_r - 1, seed)[d_s - 1 :]
    rows = spark.range(1, n + 1).withColumnRenamed("id", "rid")
    return rows.select("rid", F.array(*[_normal("r", "rid", seed, i, deviation) * float(w[i]) for i in range(d_r)]).alias("xr"))


def entity_rows(
    spark: SparkSession, ratio: int, n: int, d_s: int, d_r: int, deviation: float = 1.0, shift: bool = True, seed: int = 1
) -> DataFrame:
    """sid, label, forkey, xs: ``ratio`` rows for each of n attribute rows."""
    w = coefficients(d_s + d_r - 1, seed)[: d_s - 1]
    rows = spark.range(1, ratio * n + 1).withColumnRenamed("id", "sid")
    label = F.when(_uniforms("y", "sid", seed, 0)[0] < 0.5, -1.0).otherwise(1.0)
    around = label if shift else F.lit(0.0)
    xs = [(_normal("s", "sid", seed, i, deviation) + around) * float(w[i]) for i in range(d_s - 1)]
    vector = F.array(*xs) if xs else F.array().cast("array<double>")
    forkey = F.floor((F.col("sid") - 1) / ratio).cast("long") + 1
    return rows.select("sid", label.alias("label"), forkey.alias("forkey"), vector.alias("xs"))


def flat_rows(spark: SparkSession, ratio: int, n: int, d_s: int, d_r: int, deviation: float = 1.0, shift: bool = True, seed: int = 1) -> DataFrame:
    """sid, label, x: the same rows joined."""
    s = entity_rows(spark, ratio, n, d_s, d_r, deviation, shift, seed)
    r = attribute_rows(spark, n, d_s, d_r, deviation, seed)
    return s.join(r, s["forkey"] == r["rid"]).select("sid", "label", F.concat("xs", "xr").alias("x"))


def write_tables(
    spark: SparkSession, s_path: str, r_path: str, format_: int, ratio: int, n: int, d_s: int, d_r: int, deviation: float = 1.0,
    shift: bool = False, seed: int = 1,
) -> None:
    """Makes both tables and writes them (BINARY: columns with vectors; TEXT: lines of the Hive layout), replacing what is there."""
    s = entity_rows(spark, ratio, n, d_s, d_r, deviation, shift, seed)
    tables.sink(s, s_path, format_)
    tables.sink(attribute_rows(spark, n, d_s, d_r, deviation, seed), r_path, format_)
