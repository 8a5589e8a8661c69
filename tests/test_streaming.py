"""Sums over arriving rows are the sums over all of them."""

from __future__ import annotations

import pytest

from normlearn.operators.data import normalized
from normlearn.plans import gradient as G
from normlearn.sources import datagen
from normlearn.streaming import incremental


def test_rows_in_two_deliveries(spark, tmp_path):
    s, r = datagen.entity_rows(spark, 6, 20, 3, 2), datagen.attribute_rows(spark, 20, 3, 2)
    data, w = normalized(s, r), [0.3, -0.2, 0.1, 0.5]
    (tmp_path / "in").mkdir()
    arriving = spark.readStream.schema(data.s.schema).parquet(f"{tmp_path}/in")
    parts = (data.s.filter("sid % 2 = 0"), data.s.filter("sid % 2 = 1"))
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        incremental.start(arriving, data.r, w, 2, f"{tmp_path}/out", f"{tmp_path}/progress").awaitTermination()
    loss, g = G.collected(incremental.totals(spark, f"{tmp_path}/out", 4))
    expected = G.collected(G.factorized(data, w))
    assert loss == pytest.approx(expected[0]) and g == pytest.approx(expected[1])
