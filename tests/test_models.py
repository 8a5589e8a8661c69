"""The model catalog and tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from normlearn.functions import sql
from normlearn.operators.models import Catalog, random_vector
from normlearn.plans import gradient as G
from normlearn.sources import datagen, tables
from normlearn.operators.data import normalized


def test_life_of_a_model(spark, tmp_path):
    data = normalized(datagen.entity_rows(spark, 4, 10, 3, 2), datagen.attribute_rows(spark, 10, 3, 2))
    catalog = Catalog()
    catalog.push(7, 2, 2)
    with pytest.raises(ValueError):
        catalog.push(7, 1)
    assert catalog.get(7).tolist() == [0] * 8
    w = [0.5, -1.0, 2.0, 0.25]
    catalog.put(7, w)
    with pytest.raises(ValueError):
        catalog.put(7, [1.0])
    expected = G.collected(G.stream(data, w))
    for n, approach in enumerate(("f", "s", "fsql", "sr"), 1):
        assert catalog.gradient(7, data, approach, 2) == pytest.approx(expected[0])
        assert catalog.get(7)[4:] == pytest.approx(n * expected[1])
    catalog.put(7, w)
    assert catalog.gradient(7, G.denormalized(data)) == pytest.approx(expected[0])

    catalog.save(spark, f"{tmp_path}/models")
    again = Catalog.load(spark, f"{tmp_path}/models")
    assert again.get(7) == pytest.approx(catalog.get(7))

    rows = G.denormalized(data)
    catalog.register(spark, 7)
    tables.register(flat=rows)
    total = spark.sql("SELECT sum(model_7_loss(x, label)) l, avg(model_7_probability(x)) p FROM flat").first()
    assert total.l == pytest.approx(expected[0])
    columns = rows.agg(F.sum(catalog.loss(7, F.col("x"), F.col("label"))), F.avg(catalog.probability(7, F.col("x")))).first()
    assert tuple(columns) == pytest.approx((total.l, total.p))

    catalog.pop(7)
    with pytest.raises(KeyError):
        catalog.pop(7)


def test_tables(spark, tmp_path):
    s = datagen.entity_rows(spark, 4, 10, 3, 2)
    for _ in range(2):
        tables.write(s, f"{tmp_path}/s", 3, "forkey")
    back = tables.read(spark, f"{tmp_path}/s", tables.ENTITY)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, s.collect()))


def test_hive_names(spark):
    sql.register(spark)
    row = spark.sql("SELECT FSQLPlus1(array(1D, 2D), array(3D, 4D)) a, ConcatArray(array(1D), null) b").first()
    assert (row.a, row.b) == (11, [1])


def test_random_vectors(spark):
    rows = np.array([r.v for r in spark.range(200).select(random_vector(3, 5).alias("v")).collect()])
    assert rows.shape == (200, 3) and 0 <= rows.min() and rows.max() < 1 and len(np.unique(rows)) == 600
