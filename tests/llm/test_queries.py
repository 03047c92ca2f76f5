"""The registered training-data queries: names, and those with SQL beside DuckDB at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from check import TABLES, compare
from rankflow.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def test_all_operators_and_the_pipeline_are_registered():
    names = list(queries())
    assert all(any(name.startswith(f"op{n}_") for name in names) for n in range(1, 14)) and "pipeline" in names


@pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="driver tables not present")
@pytest.mark.parametrize("name", [name for name, (_, sql) in QUERIES.items() if sql])
def test_query(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    assert name in oracle_sql() and compare(spark, db, name, SF_DIR).startswith("ok")
