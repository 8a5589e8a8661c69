"""Folders for files that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; in local mode that is set to a temporary folder where unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="normlearn-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/normlearn/{name}-{uuid.uuid4().hex}"
