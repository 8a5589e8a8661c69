"""The registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import pytest

from normlearn import queries

ORACLES = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, sf_dir, same_rows, name):
    same_rows(queries.queries()[name](spark, sf_dir), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(ORACLES)))
def test_query_has_rows(spark, sf_dir, name):
    assert queries.queries()[name](spark, sf_dir).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(queries.queries())


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(queries.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/normlearn", tmp_path / "normlearn", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), sum(k.startswith('op') for k in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.stdout.split() == [str(len(queries.queries())), "0"]
