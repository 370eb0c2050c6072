"""Every query with SQL against DuckDB on the smallest tables, and every other one for rows and a stable schema."""

import math

import duckdb
import pytest

from tidemark import analysis_queries, block_queries, desk_queries, market_queries, text_queries  # noqa: F401
from tidemark.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    cur = duck.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = ordered(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    got = ordered(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(a == b or isinstance(a, float) and isinstance(b, float) and a == pytest.approx(b, rel=1e-6, abs=2e-4) for a, b in zip(g, w, strict=True)), (g, w)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.limit(5).count() >= 0
