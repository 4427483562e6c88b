"""Every registered visibility query against its SQL, on the smallest tables."""

import duckdb
import pytest

from visloom.plans import queries as plans

DATA = "/root/testdata/sf0.001"


def same(df, sql):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "embeddings"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    flat = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    a = sorted(repr([flat(r[c]) for c in cols]) for r in df.collect())
    b = sorted(repr([flat(r[i]) for i in at]) for r in want.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(plans.queries()[name](spark, DATA), plans.oracle_sql()[name])
