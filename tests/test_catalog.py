"""Every query against its SQL twin over the smallest tables, and the driver's entry points."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from vicinia.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in Path(SF).iterdir():
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(rows):
    return sorted(repr(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, sql, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    con = sql.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == columns
    want = [[r[names.index(c)] for c in columns] for r in con.fetchall()]
    assert plain(df.select(*columns).collect()) == plain(want)


def test_queries_without_a_twin(spark):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries()) and set(catalog.oracle_sql()) <= set(__spark_entry__.oracle_sql())


def test_listed_indexes_are_whole(spark):
    from vicinia.plans.catalog import queries

    where, all_queries = "/root/testdata/sf0.01", queries()
    tables = {"lsh_cosine_index": 128, "lsh_stable_index": 112, "store_keys": 32, "store_clear": 31}
    assert {n: all_queries[n](spark, where).select("table_id").distinct().count() for n in tables} == tables
