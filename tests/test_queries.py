"""Every query against its SQL twin on the smallest tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

CORE = {k: v for m in entry._MODULES if "llm" not in m for k, v in __import__(m, fromlist=["x"]).queries().items()}
SQL = {k: v for m in entry._MODULES if "llm" not in m for k, v in __import__(m, fromlist=["x"]).oracle_sql().items()}


@pytest.fixture(scope="module")
def db(root):
    c = duckdb.connect()
    for f in glob.glob(root + "/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else repr(round(v, 6))
    return str(v)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, root, db, name):
    df = CORE[name](spark, root)
    cols = sorted(df.columns)
    rows = Counter(tuple(plain(x) for x in r) for r in df.select(*cols).collect())
    if name not in SQL:
        assert sum(rows.values()) > 0
        return
    result = db.execute(SQL[name])
    have = [d[0] for d in result.description]
    assert sorted(have) == cols
    at = [have.index(c) for c in cols]
    assert rows == Counter(tuple(plain(r[i]) for i in at) for r in result.fetchall())


def test_names_and_entry(spark, root):
    assert set(SQL) <= set(CORE)
    assert entry.entry(spark).columns == ["tab", "row_id", "entity", "item_pos", "pos", "part_pos", "name"]
