from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("the driver's tables are not here")
    return path


def plain(value):
    """A value that Spark and DuckDB show alike."""
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, (list, tuple)) or hasattr(value, "tolist"):
        return str([plain(v) for v in value])
    return str(value)


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


@pytest.fixture
def same_rows(duck):
    """Holds a DataFrame against SQL: the same columns and the same rows in any order."""

    def compare(frame, sql: str) -> None:
        columns = sorted(frame.columns)
        relation = duck.sql(sql)
        assert sorted(relation.columns) == columns
        expected = relation.project(", ".join(f'"{c}"' for c in columns)).fetchall()
        found = [tuple(plain(v) for v in row) for row in frame.select(*columns).collect()]
        assert sorted(found) == sorted(tuple(plain(v) for v in row) for row in expected)

    return compare
