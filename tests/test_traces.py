"""Training runs that end without a step, against their SQL: rows repeated until a direction does not descend."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry

COPIES = 10


@pytest.fixture(scope="module")
def repeated(sf_dir, tmp_path_factory):
    """(folder, DuckDB connection) with lineitem and part repeated under shifted keys."""
    import duckdb

    folder, con = tmp_path_factory.mktemp("repeated"), duckdb.connect()
    for name, keys in (("lineitem", ("l_orderkey", "l_partkey")), ("part", ("p_partkey",))):
        moved = ", ".join(f"{k} + i * 1000000 AS {k}" for k in keys)
        rows = f"SELECT t.* REPLACE ({moved}) FROM read_parquet('{sf_dir}/{name}.parquet') t, range({COPIES}) r(i)"
        con.execute(f"COPY ({rows}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return str(folder), con


def _same(spark, repeated, name: str) -> None:
    folder, con = repeated
    expected = con.sql(entry.oracle_sql()[name] + " ORDER BY iter").fetchall()
    assert expected[-1][1:] == (None,) * 4  # the run ends without a step
    found = [tuple(r) for r in entry.queries()[name](spark, folder).collect()]
    assert found == expected


def test_cgd_trace(spark, repeated):
    _same(spark, repeated, "cgd_trace")


def test_spec_trace(spark, repeated):
    _same(spark, repeated, "spec_trace")


def test_single_trace(spark, repeated):
    _same(spark, repeated, "single_trace")
