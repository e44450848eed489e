"""Every query with SQL gives what DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

from talkmine.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for t in TABLES:
        made.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return made


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    return v if v is None or isinstance(v, bool) else str(v)


def rows_of(dicts):
    return sorted(repr(sorted((k, plain(v)) for k, v in d.items())) for d in dicts)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, con, name):
    made = [r.asDict() for r in catalog.queries()[name](spark, FOLDER).collect()]
    want = con.sql(catalog.oracle_sql()[name])
    assert rows_of(made) == rows_of(dict(zip(want.columns, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_others_run(spark, name):
    catalog.queries()[name](spark, FOLDER).collect()
