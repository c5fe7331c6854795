"""The driver contract, and queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_contract():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 45


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", ["score_lift", "effect_table", "psi_table", "woe_table", "clean_impute_clip", "swap_analysis"])
def test_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("lineitem", "orders"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, DATA).toPandas()[list(want.columns)]
    assert len(got) == len(want)
    order = sorted(want, key=lambda c: want[c].dtype.kind == "f")
    a, b = (x.sort_values(order).reset_index(drop=True) for x in (got, want))
    for c in want:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c
