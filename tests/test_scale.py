"""Plans have the shape that holds at scale."""

from __future__ import annotations

import pytest

from normlearn.plans import gradient as G
from normlearn.queries import main_data

W = [0.1] * 5


def explained(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("plan", [G.stream, G.factorized, G.fsql, lambda d, w: G.stream_reuse(d, w, 4)])
def test_scans_are_pruned_and_filtered(spark, sf_dir, plan):
    text = explained(plan(main_data(spark, sf_dir), W))
    scans = [line for line in text.splitlines() if "FileScan" in line]
    assert scans and all("IsNotNull" in line for line in scans)
    for line in scans:
        schema = line.split("ReadSchema: ")[1]
        assert "l_comment" not in schema and "p_name" not in schema and "l_suppkey" not in schema


@pytest.mark.parametrize("plan", [G.stream, G.factorized, G.fsql])
def test_sums_are_partial_before_a_shuffle(spark, sf_dir, plan):
    text = explained(plan(main_data(spark, sf_dir), W))
    assert "partial_sum" in text and "BatchEvalPython" not in text and "Cartesian" not in text


def test_nothing_is_broadcast_against_its_size(spark, sf_dir):
    """Without a size bound the joins are sorted merges, in every plan."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for plan in (G.stream, G.factorized, G.fsql):
            text = explained(plan(main_data(spark, sf_dir), W))
            assert "SortMergeJoin" in text and "Broadcast" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_skewed_key_gives_the_same_sums(spark):
    from pyspark.sql import functions as F

    from normlearn.operators.data import normalized

    rows = spark.range(20000)
    s = rows.select(
        F.col("id").alias("sid"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(-1.0).alias("label"),
        F.when(F.col("id") % 10 < 7, 5).otherwise(F.col("id") % 100).alias("forkey"), F.array(F.col("id") / 20000).alias("xs"),
    )
    r = spark.range(100).select(F.col("id").alias("rid"), F.array(F.col("id") / 100, F.lit(1.0)).alias("xr"))
    data = normalized(s, r)
    expected = G.collected(G.stream(data, [0.5, -0.2, 0.1]))
    for plan in (G.factorized, G.fsql):
        loss, g = G.collected(plan(data, [0.5, -0.2, 0.1]))
        assert loss == pytest.approx(expected[0]) and g == pytest.approx(expected[1])


@pytest.fixture
def threshold(spark):
    """Sets from which size on nothing is broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    yield lambda value: spark.conf.set("spark.sql.autoBroadcastJoinThreshold", value)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_large_tables_are_dealt_out_once(spark, sf_dir, threshold):
    """Passes over tables kept by key shuffle nothing but the one row of sums."""
    from normlearn.operators.data import parts_by_key, validate

    threshold("1k")
    data = main_data(spark, sf_dir)
    parts = parts_by_key(data, validate(data))
    assert parts == int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = data.cached(parts)
    expected = G.collected(G.stream(data, W))
    for plan in (G.stream, G.factorized, G.fsql):
        frame = plan(kept, W)
        loss, g = G.collected(frame)
        assert loss == pytest.approx(expected[0]) and g == pytest.approx(expected[1])
        frame.collect()
        final = explained(frame).split("== Initial Plan ==")[0]
        assert "Exchange hashpartitioning" not in "".join(x for x in final.splitlines() if "REPARTITION" not in x)
    kept.release()


@pytest.mark.parametrize(("limit", "expected"), [("10m", None), ("10485760", None), ("10485760b", None), ("64", 4), ("-1", 4)])
def test_small_tables_are_broadcast_instead(spark, threshold, limit, expected):
    from normlearn.operators.data import NormalizedData, parts_by_key

    threshold(limit)
    data = NormalizedData(spark.range(1), spark.range(1), 3, 4)
    assert parts_by_key(data, {"n_s": 1000, "n_r": 100, "most_s": 20}) == expected
    assert parts_by_key(data, {"n_s": 1000, "n_r": 100, "most_s": 990}) is None


def test_stream_reuse_splits_once(spark, sf_dir, threshold):
    """Over tables that are split and kept, a pass joins the splits without a shuffle or a sort of them."""
    threshold("-1")
    data = main_data(spark, sf_dir)
    expected = G.collected(G.stream(data, W))
    kept = data.split(3).kept()
    for _ in range(2):
        frame = G.stream_reuse(kept, W, 3)
        loss, g = G.collected(frame)
        assert loss == pytest.approx(expected[0]) and g == pytest.approx(expected[1])
        frame.collect()
        final = explained(frame).split("== Initial Plan ==")[0]
        below = final[final.index("SortMergeJoin") :]
        below = "\n".join(line for line in below.splitlines() if "REPARTITION" not in line)
        above_cache = below.split("InMemoryRelation")[0]
        assert "Exchange" not in above_cache and "Sort [" not in above_cache
    kept.release()


def test_long_entity_vectors_are_summed_whole(spark):
    """Entity vectors of any width give sums of vectors, not an aggregate for each element."""
    from pyspark.sql import functions as F

    from normlearn.operators.data import normalized

    rows = spark.range(400)
    s = rows.select(
        F.col("id").alias("sid"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(-1.0).alias("label"), (F.col("id") % 7).alias("forkey"),
        F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.sin(F.col("id") * i)).alias("xs"),
    )
    r = spark.range(7).select(F.col("id").alias("rid"), F.array(F.col("id") / 7, F.lit(1.0)).alias("xr"))
    data = normalized(s, r)
    w = [0.01 * (i - 20) for i in range(42)]
    expected = G.collected(G.stream(data, w))
    for plan in (G.factorized, G.fsql):
        frame = plan(data, w)
        assert explained(frame).count("partial_sum(") < 20
        loss, g = G.collected(frame)
        assert loss == pytest.approx(expected[0]) and g == pytest.approx(expected[1])
    assert len(G.hs_plus(data, w).first().lg) == 42
    assert G.collected(G.entity_sums(G.per_key(data, w), 40))[0] == pytest.approx(expected[0])
