"""Registered queries against their SQL, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidelake import queries as flow

DATA = Path("/root/testdata/sf0.001")


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


def test_every_query_has_a_name_in_both():
    assert set(flow.ORACLES) == set(flow.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", list(flow.QUERIES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = flow.QUERIES[name](spark, str(DATA)), con.sql(flow.ORACLES[name])
    expected = table(want.fetchall(), want.columns)
    assert expected and table(map(tuple, got.collect()), got.columns) == expected


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_flattened_floats_are_rounded_as_floats(spark, tmp_path):
    """Thousandths whose product is a half as a float and not quite one as a double, and halves themselves."""
    con = duckdb.connect()
    con.sql("CREATE TABLE embeddings AS SELECT [CAST((i + 0.5) / 1000 AS FLOAT) FOR i IN range(-400, 400)] || [NULL, 0.5::FLOAT, -0.0005::FLOAT, 1234.5675::FLOAT] AS embedding")
    con.sql(f"COPY embeddings TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    got, want = flow.QUERIES["flatten_array"](spark, str(tmp_path)), con.sql(flow.ORACLES["flatten_array"])
    assert table(map(tuple, got.collect()), got.columns) == table(want.fetchall(), want.columns)
