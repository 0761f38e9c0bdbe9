"""Every catalogue query against its DuckDB SQL on the smallest test tables."""

import math
from pathlib import Path

import pytest

from docobjects.plans import catalog, editing, pdf_catalog

ORACLES, QUERIES = {**catalog.ORACLES, **editing.SQL, **pdf_catalog.ORACLES}, {**catalog.QUERIES, **editing.ADDED, **pdf_catalog.QUERIES}

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return int(value) if isinstance(value, int) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    want = duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"text_cross_file_groups", "pdf_placements", "pdf_clean_roundtrip"} <= set(entry.queries())
