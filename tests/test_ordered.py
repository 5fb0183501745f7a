import random

import pytest
from pyspark.sql import functions as F

from vicinia.operators.ordered import as_of


def brute(left, right, within=None):
    out = []
    for k, t, x in left:
        met = [(u, i) for j, u, i in right if None not in (k, t, j, u) and j == k and u <= t and (within is None or u >= t - within)]
        out.append((k, t, x, max(met, key=lambda m: (m[0], m[1] is not None, m[1] or 0))[1] if met else None))
    return sorted(map(repr, out))


def frames(spark, left, right):
    return spark.createDataFrame(left, "k long, t long, x long"), spark.createDataFrame(right, "k int, t long, x long")


@pytest.mark.parametrize("within", [None, 3])
def test_equals_brute_force(spark, within):
    rng = random.Random(1)
    some = lambda n, base: [(rng.choice((1, 1, 1, 2, 3, 4, None)), rng.choice((None, *range(200))), base + i) for i in range(n)]
    left, right = some(300, 0), some(60, 1000)
    left += left[:20] + [(9, 5, 1), (1, 10_000, 2)]
    right += [(1, 50, None), (1, 50, 3), (8, 1, 4)]
    a, b = frames(spark, left, right)
    got = as_of(a, b, ["k"], "t", "x", None if within is None else F.lit(within))
    assert got.columns == ["k", "t", "x", "met"]
    assert sorted(repr((r.k, r.t, r.x, r.met.x if r.met else None)) for r in got.collect()) == brute(left, right, within)


def test_a_hot_key_is_dealt_and_its_last_row_carried(spark):
    """One right row at the very start serves left rows in every range."""
    left, right = [(7, t, t) for t in range(1, 3000)], [(7, 0, 5), (6, 9, 8)]
    a, b = frames(spark, left, right)
    met = as_of(a, b, ["k"], "t", "x")
    assert {r.met.x for r in met.collect()} == {5} and met.count() == len(left)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_without_keys_clashing_names_and_empty_tables(spark):
    a, b = frames(spark, [(1, 5, 1), (None, 7, 2)], [(2, 5, 3), (3, 6, 4)])
    names = ["l", "r", "part", "side", "tie", "spread", "m", "at", "met"]
    wide = lambda d: d.select("*", *[F.lit("x").alias(c) for c in names])
    got = as_of(wide(a), wide(b), [], "t", "x").collect()
    assert sorted((r.t, r.met.x, r.l, r.met.met) for r in got) == [(5, 3, "x", "x"), (7, 4, "x", "x")]
    assert as_of(a.limit(0), b, ["k"], "t", "x").collect() == []
    assert [r.met for r in as_of(a, b.limit(0), ["k"], "t", "x").collect()] == [None, None]
