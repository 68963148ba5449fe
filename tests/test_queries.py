"""Registered queries against their SQL in DuckDB at the smallest scale."""

import math

import duckdb
import pytest

from tallywork import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()


def norm(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return float(x) if type(x).__name__ in ("int", "float", "Decimal") else str(x)[:10] if type(x).__name__ in ("date", "datetime") else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=str)
    out = duck.execute(plans.oracle_sql()[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    want = sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in out.fetchall()), key=str)
    assert got == want


def test_entry_works_without_optional_parts(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).limit(1).count() == 1
