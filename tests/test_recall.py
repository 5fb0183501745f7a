"""Recall queries of the other hash families equal their SQL twins."""

import duckdb
import pytest

from vicinia.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["recall_cosine", "recall_stable", "recall_cosine_multiprobe", "recall_stable_multiprobe", "recall_voronoi_multiprobe"])
def test_equals_sql(spark, name):
    got = [tuple(r) for r in catalog.queries()[name](spark, SF).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    assert got == con.execute(catalog.oracle_sql()[name]).fetchall() and got[0][0] == 25
