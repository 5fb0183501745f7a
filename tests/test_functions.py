import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vicinia.functions import encoding, sampling, stable


def test_bits_of_codes():
    assert [encoding.bits_for(n) for n in (2, 3, 4, 5, 8, 9)] == [1, 2, 2, 3, 3, 4]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.integers(0, 7), min_size=4, max_size=4), min_size=1, max_size=20), st.lists(st.lists(st.integers(-10**6, 10**6), min_size=4, max_size=4), min_size=1, max_size=20))
def test_encoders_round_trip(small, wide):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or SparkSession.builder.master("local[4]").getOrCreate()
    df = spark.createDataFrame([(x,) for x in small], "c array<int>")
    key = encoding.encode_by_bits(F.col("c"), 4, 3)
    for r in df.select("c", key.alias("k"), encoding.decode_by_bits(key, 4, 3).alias("back"), encoding.key_distance(key, F.lit(0).cast("long"), 4, 3).alias("far")).collect():
        assert r.back == r.c and r.k == sum(x << 3 * j for j, x in enumerate(r.c)) and r.far == sum(x != 0 for x in r.c)
    df = spark.createDataFrame([(x,) for x in wide], "c array<long>")
    key = encoding.encode_by_place(F.col("c"), 4)
    for r in df.select("c", key.alias("k"), encoding.decode_by_place(key, 4).alias("back")).collect():
        zig = [2 * x if x > 0 else -2 * x - 1 if x < 0 else 0 for x in r.c]
        assert r.back == r.c and int(r.k) == sum(z * 10 ** (8 * j) for j, z in enumerate(zig))


def test_encoder_limits(spark):
    for call in (lambda: encoding.encode_by_bits(F.col("c"), 8, 8), lambda: encoding.encode_by_place(F.col("c"), 5)):
        with pytest.raises(ValueError, match="don't fit"):
            call()
    df = spark.createDataFrame([([123, -7],)], "c array<int>")
    assert int(df.select(encoding.encode_by_place(F.col("c"), 2, 2)).first()[0]) == 1346  # 246 keeps its low digits
    assert df.select(encoding.key_distance(F.lit(5).cast("long"), F.lit(3).cast("long"), 8, 1)).first()[0] == 2


def test_index_samples():
    rng = np.random.default_rng(0)
    s = sampling.sample_indices(20, 5, 20, rng=rng)
    assert s.shape == (5, 20) and all(sorted(x) == list(range(20)) for x in s.tolist())
    assert sampling.sample_indices(3, 4, 50, replace=True, rng=rng).max() == 2
    s = sampling.sample_intervals(25, 10, 3, 5, rng=rng)
    assert s.shape == (3, 15)
    for row in s.reshape(3, 3, 5).tolist():
        assert all(a <= x < b for part, (a, b) in zip(row, ((0, 10), (10, 20), (20, 25)), strict=True) for x in part) and all(len(set(p)) == 5 for p in row)
    for bad in (lambda: sampling.sample_indices(3, 1, 4), lambda: sampling.sample_intervals(25, 10, 1, 6)):
        with pytest.raises(ValueError, match="distinct"):
            bad()


def test_distributed_samples(spark):
    df = spark.range(100).repartition(7)
    rows = sampling.sample_rows(df, 3, 10, seed=1).collect()
    assert sorted((r.sample, r.id) for r in rows) == sorted((r.sample, r.id) for r in sampling.sample_rows(spark.range(100), 3, 10, seed=1).collect())
    by = {k: {r.id for r in rows if r.sample == k} for k in range(3)}
    assert all(len(x) == 10 for x in by.values()) and by[0] != by[1]
    strata = sampling.sample_strata(df, 30, 2, 4, seed=1).collect()
    assert len(strata) == 4 * 2 * 4 and all(r.id // 30 == r.stratum for r in strata)
    drawn = sampling.interval_draws(spark, 25, 10, 2, 6, seed=3).collect()
    assert len(drawn) == 3 * 2 * 6 and all(r.id // 10 == r.stratum and r.id < 25 for r in drawn)
    assert all(5 <= r.id < 15 for r in sampling.draws(spark, 10, 2, 50, seed=3, begin=5).collect())
    assert sampling.line_sample(df, 7).count() == 7


@pytest.mark.parametrize(("alpha", "beta"), [(2.0, 0.0), (1.0, 0.0), (1.0, 0.5), (1.5, 0.5), (0.5, 1.0)])
def test_stable_laws(spark, alpha, beta):
    rng = np.random.default_rng(1)
    x = np.quantile(stable.stable(alpha, beta, size=40_000, rng=rng), [0.25, 0.5, 0.75])
    y = np.quantile([r[0] for r in spark.range(40_000).select(stable.stable_column(F.rand(1), F.rand(2), alpha, beta)).collect()], [0.25, 0.5, 0.75])
    np.testing.assert_allclose(x, y, rtol=0.05, atol=0.05)  # sampling error, larger in the tails
    if alpha == 2:
        assert abs(x[2] - 0.6745 * math.sqrt(2)) < 0.03
        assert abs(stable.stable(2, c=3, size=40_000, rng=rng, convention="reference").std() - 9) < 0.2
    if (alpha, beta) == (1, 0):
        np.testing.assert_allclose(x, [-1, 0, 1], atol=0.05)
    if alpha == 0.5 and beta == 1:
        assert (stable.stable(0.5, 1, size=1000, rng=rng) >= 0).all()


def test_stable_scale_and_checks():
    a = stable.stable(1, 0.5, 2.0, 3.0, 1000, np.random.default_rng(4))
    b = stable.stable(1, 0.5, 1.0, 0.0, 1000, np.random.default_rng(4))
    np.testing.assert_allclose(a, 2 * b + 3 + 2 / math.pi * 0.5 * 2 * math.log(2))
    for bad in ((0, 0, 1), (2.1, 0, 1), (1, 1.5, 1), (1, 0, 0)):
        with pytest.raises(ValueError):
            stable.stable(*bad)
