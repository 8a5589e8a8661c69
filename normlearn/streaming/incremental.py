"""Loss and gradient at fixed coefficients, kept up to date as entity rows arrive.

Both are sums over rows, so the sums of each micro-batch add up to the sums over
all rows seen.  Batches are appended to a table under their number, so a batch
that runs again replaces its own row and is counted once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from normlearn.operators.data import NormalizedData
from normlearn.plans import gradient as G


def start(entities: DataFrame, attributes: DataFrame, w: Sequence[float], d_s: int, out: str, checkpoint: str) -> StreamingQuery:
    """Runs over what ``entities`` (a stream of sid, label, forkey, xs) has; sums go to ``out``, a row a batch."""

    def add(batch: DataFrame, number: int) -> None:
        data = NormalizedData(batch.dropna(subset=["label", "forkey", "xs"]), attributes, d_s, len(w) - d_s)
        G.factorized(data, w).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        entities.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def totals(spark, out: str, d: int) -> DataFrame:
    """(loss, g0, ...) over all batches."""
    rows = spark.read.parquet(out)
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("loss", *G.names(d))])
