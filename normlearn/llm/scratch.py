"""Tables written to the shared folder of the session, to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; in local mode it is set to a temporary folder where unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="normlearn-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/normlearn/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder, and read from there."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def mark() -> int:
    """A point in time for ``remove_since``."""
    return len(_WRITTEN)


def remove_since(point: int, *but: DataFrame) -> None:
    """Deletes the tables written since ``point`` except ``but``, once a table made from them is written."""
    kept = {df._scratch_path for df in but}
    for spark, path in _WRITTEN[point:]:
        if path not in kept:
            remove_path(spark, path)
    _WRITTEN[point:] = [x for x in _WRITTEN[point:] if x[1] in kept]


def remove(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for df in tables:
        remove_path(df.sparkSession, df._scratch_path)


def remove_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        if spark.sparkContext._jsc is not None:
            try:
                remove_path(spark, path)
            except Exception:  # noqa: BLE001 - the JVM may be gone at exit
                return
