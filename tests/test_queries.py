"""Each registered query of the library against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from segue.plans import queries as Q

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.fixture(scope="module", autouse=True)
def shared_steps():
    """Fitted tables are shared by the queries of this module."""
    own, runs = Q.Run, {}
    Q.Run = lambda spark, d: runs.setdefault(d, own(spark, d)) if d not in runs else runs[d]
    yield
    Q.Run = own


def text(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.fixture(autouse=True)
def nothing_stays_cached(spark):
    yield
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, db, name):
    df = Q.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    rows = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    if name in Q.ORACLES:
        got = db.execute(Q.ORACLES[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert rows == sorted(tuple(text(x[i]) for i in at) for x in got.fetchall())
    else:
        assert rows
