"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from evenhand.plans import queries

DATA = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value if value is None or isinstance(value, (bool, int, str)) else float(value) if hasattr(value, "quantize") else str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in sorted(os.listdir(DATA)):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


def differs(spark, tables, name, sql):
    df = queries.QUERIES[name](spark, DATA)
    found = tables.execute(sql)
    return table(df.columns, [tuple(r) for r in df.collect()]) != table([c[0] for c in found.description], found.fetchall())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, tables, name):
    assert not differs(spark, tables, name, queries.SQL[name])


def test_a_broken_oracle_is_seen(spark, tables):
    assert differs(spark, tables, "g1_denial_rate", queries.SQL["g1_denial_rate"].replace("'3'", "'2'"))
    with pytest.raises(duckdb.Error):
        differs(spark, tables, "g1_denial_rate", queries.SQL["g1_denial_rate"].replace("from", "from {b}"))
