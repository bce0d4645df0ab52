"""Every query with SQL against DuckDB on the smallest tables, those that decide by rounded numbers on larger ones too; the rest must run and give rows."""

import math
import os

import duckdb
import pytest

from cutroom import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LARGER = "/root/testdata/sf0.01"
#: Queries whose results hang on the order of computed numbers: more rows show what a few do not.
BY_ORDER = ("suggested_segments", "selection_runs", "auto_select_by_score", "auto_select_in_turns", "auto_select_with_fallback", "photo_clusters", "fallback_stories", "motion_classes", "draft_faults")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return tuple(map(plain, value)) if isinstance(value, list) else value


@pytest.fixture(scope="module")
def duck():
    def opened(folder):
        connection = duckdb.connect()
        for name in TABLES:
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
        return connection

    return {folder: opened(folder) for folder in {SF, LARGER}}


@pytest.mark.parametrize(("name", "folder"), [*((name, SF) for name in sorted(catalogue.QUERIES)), *((name, LARGER) for name in BY_ORDER)])
def test_query(spark, duck, name, folder):
    df = catalogue.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    found = duck[folder].execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in found.fetchall()), key=repr)
    assert got == want
