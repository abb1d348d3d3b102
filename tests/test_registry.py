from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from check import _rows
from teleledger.plans import registry

SMALL = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(registry.oracle_sql()) == set(registry.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", ["digestions", "program_search", "recording_patch", "view_ingest", "epg_unique", "series_links"])
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = entry_points.queries()[name](spark, SMALL)
    want = duck.execute(entry_points.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(columns, want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_entry(spark):
    assert entry_points.entry(spark).count() == 100
