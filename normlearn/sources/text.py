"""Text files of entity and attribute tables.

Layouts, a line a row, fields separated by blanks:

* plain S: ``sid label forkey x1 x2 ...``; plain R: ``rid x1 x2 ...``
* Hive S: ``sid forkey label x1,x2,...``; Hive R: ``rid x1,x2,...``
* flat T: ``sid label x1 x2 ...``

Readers split on any run of white space and skip blank lines; all of it is
DataFrame functions, so files of any size are read in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fields(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> ''")
    return lines.select(F.split("value", r"\s+").alias("f"))


def _doubles(strings: Column) -> Column:
    return F.transform(strings, lambda v: v.cast("double"))


def _from(i: int) -> Column:
    return _doubles(F.slice("f", i + 1, F.greatest(F.size("f") - i, F.lit(0))))


def _key(i: int) -> Column:
    return F.get("f", i).cast("long")


def read_plain_s(spark: SparkSession, path: str) -> DataFrame:
    label = F.get("f", 1).cast("double")
    return _fields(spark, path).select(_key(0).alias("sid"), label.alias("label"), _key(2).alias("forkey"), _from(3).alias("xs"))


def read_plain_r(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path).select(_key(0).alias("rid"), _from(1).alias("xr"))


def read_hive_s(spark: SparkSession, path: str) -> DataFrame:
    xs = _doubles(F.split(F.get("f", 3), ","))
    return _fields(spark, path).select(
        _key(0).alias("sid"), _key(1).alias("forkey"), F.get("f", 2).cast("double").alias("label"), xs.alias("xs")
    )


def read_hive_r(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path).select(_key(0).alias("rid"), _doubles(F.split(F.get("f", 1), ",")).alias("xr"))


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """All fields are numbers; the first is kept as sid."""
    sid = F.get("f", 0).cast("double").cast("long")
    return _fields(spark, path).select(sid.alias("sid"), F.get("f", 1).cast("double").alias("label"), _from(2).alias("x"))


def _joined(x: str, by: str) -> Column:
    return F.array_join(F.transform(x, lambda v: v.cast("string")), by)


def _written(line: Column, rows: DataFrame, path: str) -> None:
    rows.select(line.alias("value")).write.mode("overwrite").text(path)


def write_plain_s(rows: DataFrame, path: str) -> None:
    _written(F.concat_ws(" ", "sid", "label", "forkey", _joined("xs", " ")), rows, path)


def write_plain_r(rows: DataFrame, path: str) -> None:
    _written(F.concat_ws(" ", "rid", _joined("xr", " ")), rows, path)


def write_hive_s(rows: DataFrame, path: str) -> None:
    _written(F.concat_ws(" ", "sid", "forkey", "label", _joined("xs", ",")), rows, path)


def write_hive_r(rows: DataFrame, path: str) -> None:
    _written(F.concat_ws(" ", "rid", _joined("xr", ",")), rows, path)


def write_flat(rows: DataFrame, path: str) -> None:
    _written(F.concat_ws(" ", "sid", "label", _joined("x", " ")), rows, path)
