"""Each query beside its SQL on the smallest tables: same columns, same rows, bit for bit."""

import duckdb
import pytest

from tessella import catalog


def normal(v):
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    got = df.collect()
    assert got
    if name not in catalog.ORACLES:
        return
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted([tuple(normal(dict(zip(names, r))[n]) for n in order) for r in cur.fetchall()], key=str)
    assert sorted([tuple(normal(r[n]) for n in order) for r in got], key=str) == want
