"""Every query with an oracle gives the oracle's rows on the smallest given tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op"))


@pytest.fixture(scope="module")
def engine(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(got):
    return sorted((tuple(map(plain, r)) for r in got), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, sf, engine, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    names = ", ".join(f'"{c}"' for c in cols)
    want = engine.sql(f"select {names} from ({entry.oracle_sql()[name]})")
    assert rows(df.select(*[f"`{c}`" for c in cols]).collect()) == rows(want.fetchall())


def test_entry(spark):
    got = entry.entry(spark).collect()
    assert len(got) == 1 and got[0].match is False


def test_every_query_is_named_once():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(NAMES) > 100
