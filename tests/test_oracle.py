"""Each query against its SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from lumensift.oracle import ORACLE_SQL
from lumensift.queries import QUERIES


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    assert rows
    if name in ORACLE_SQL:
        db = duckdb.connect()
        for path in glob.glob(f"{sf_dir}/*.parquet"):
            db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        want = db.sql(ORACLE_SQL[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert rows == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def test_every_query_but_long_snippets_has_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == {"highlight_documents"}
