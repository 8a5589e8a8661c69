"""Entity and attribute tables in columnar files and as views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from normlearn.sources import text

_VECTOR = ArrayType(DoubleType(), containsNull=False)
ENTITY = StructType(
    [StructField("sid", LongType()), StructField("label", DoubleType()), StructField("forkey", LongType()), StructField("xs", _VECTOR)]
)
ATTRIBUTE = StructType([StructField("rid", LongType()), StructField("xr", _VECTOR)])
FLAT = StructType([StructField("sid", LongType()), StructField("label", DoubleType()), StructField("x", _VECTOR)])

#: Numbers of formats.
BINARY, TEXT = 0, 1


def write(rows: DataFrame, path: str, parts: int | None = None, by: str | None = None) -> None:
    """Replaces what is at ``path``.  ``by`` with ``parts`` deals rows out by a key, so that equal keys share a file."""
    if parts:
        rows = rows.repartition(parts, *([by] if by else []))
    rows.write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def sink(rows: DataFrame, path: str, format_: int) -> None:
    """Writes an entity or attribute table: 0 is binary (Parquet), 1 is text of the Hive layout.  Replaces what is there."""
    if format_ not in (BINARY, TEXT):
        raise ValueError(f"unknown format {format_!r}; 0 is binary, 1 is text")
    if format_ == BINARY:
        write(rows, path)
    elif "forkey" in rows.columns:
        text.write_hive_s(rows, path)
    else:
        text.write_hive_r(rows, path)


def source(spark: SparkSession, path: str, format_: int, schema: StructType) -> DataFrame:
    """What ``sink`` wrote: a table of ENTITY or ATTRIBUTE."""
    if format_ == BINARY:
        return read(spark, path, schema)
    return text.read_hive_s(spark, path) if schema is ENTITY else text.read_hive_r(spark, path)


def load(spark: SparkSession, lines: str, path: str, schema: StructType, name: str) -> DataFrame:
    """Lines of the plain layout copied into a table at ``path``, which is then known as ``name``."""
    rows = text.read_plain_s(spark, lines) if schema is ENTITY else text.read_plain_r(spark, lines)
    write(rows, path)
    table = read(spark, path, schema)
    register(**{name: table})
    return table


def register(**tables: DataFrame) -> None:
    """Temporary views by name."""
    for name, rows in tables.items():
        rows.createOrReplaceTempView(name)
