"""The queries that have SQL against it, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from tidelake.llm.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", list(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = QUERIES[name](spark, str(DATA)), con.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    expected = sorted(repr(tuple(r[want.columns.index(c)] for c in columns)) for r in want.fetchall())
    assert expected and sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == expected
