"""The corpus queries against their SQL in DuckDB on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from siftwell.llm import queries

TABLES = ("documents", "embeddings", "pages")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_gives_what_its_sql_gives(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    plain = lambda v: (None if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v
    got = queries.queries()[name](spark, sf)
    columns = sorted(got.columns)
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    rows = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall())
    assert rows and rows == Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
