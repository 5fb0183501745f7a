"""Samples of ids: whole-range and stratified, with and without replacement, and medoid draws.

The driver forms serve small draws of indices. The distributed forms order the rows of a
table by a seeded hash, so a sample is the same however the table is partitioned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sample_indices(n: int, m: int, s: int, replace: bool = False, rng: np.random.Generator | None = None) -> np.ndarray:
    """m samples of s indices from [0, n): distinct within a sample unless ``replace``."""
    if s > n and not replace:
        raise ValueError(f"{s} distinct indices can't come from {n}")
    rng = rng or np.random.default_rng()
    return np.stack([rng.choice(n, s, replace=replace) for _ in range(m)]) if m else np.empty((0, s), dtype=np.int64)


def sample_intervals(n: int, k: int, m: int, s: int, replace: bool = False, rng: np.random.Generator | None = None) -> np.ndarray:
    """m samples of s indices from each interval [0, k), [k, 2k), ... of [0, n); the last may be shorter. Shape (m, intervals * s)."""
    rng = rng or np.random.default_rng()
    starts = range(0, n, k)
    if not replace and any(min(k, n - a) < s for a in starts):
        raise ValueError(f"{s} distinct indices can't come from the shortest interval")
    return np.stack([np.concatenate([a + rng.choice(min(k, n - a), s, replace=replace) for a in starts]) for _ in range(m)]) if m else np.empty((0, len(starts) * s), dtype=np.int64)


def _order(id_col: str, seed: int, sample: Column | None = None) -> Column:
    parts = [F.col(id_col), F.lit(seed)] + ([sample] if sample is not None else [])
    return F.xxhash64(*parts)


def sample_rows(df: DataFrame, m: int, s: int, seed: int = 0, id_col: str = "id", order: Column | None = None) -> DataFrame:
    """m samples of s distinct rows: columns ``sample`` and the id. Samples may share rows.

    Each sample is a top-s by hash, kept partial in every partition before it is merged,
    so s rows a partition and sample are shuffled. ``order`` replaces the hash (it may use
    the column ``sample``).
    """
    rows = df.select(F.col(id_col), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("sample"))
    key = _order(id_col, seed, F.col("sample")) if order is None else order
    place = F.row_number().over(Window.partitionBy("sample").orderBy(key, F.col(id_col)))
    return rows.withColumn("_place", place).where(F.col("_place") <= s).select("sample", id_col)


def sample_strata(df: DataFrame, k: int, m: int, s: int, seed: int = 0, id_col: str = "id", order: Column | None = None) -> DataFrame:
    """m samples of s distinct rows from each stratum ``id div k``: columns stratum, sample and the id."""
    rows = df.select(F.col(id_col), F.floor(F.col(id_col) / k).cast("long").alias("stratum"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("sample"))
    key = _order(id_col, seed, F.col("sample")) if order is None else order
    place = F.row_number().over(Window.partitionBy("stratum", "sample").orderBy(key, F.col(id_col)))
    return rows.withColumn("_place", place).where(F.col("_place") <= s).select("stratum", "sample", id_col)


def uniform(*parts: Column | int) -> Column:
    """A number in [0, 1) from the parts' MD5, so that it doesn't depend on partitions."""
    text = F.concat_ws(":", *[(F.lit(p) if isinstance(p, int) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def draws(spark: SparkSession, n: int, m: int, s: int, seed: int = 0, begin: int = 0) -> DataFrame:
    """m samples of s indices from [begin, begin + n) with replacement: sample, draw, id."""
    return spark.range(m * s).select((F.col("id") / s).cast("long").alias("sample"), F.pmod(F.col("id"), F.lit(s)).alias("draw"), (F.floor(uniform(seed, F.col("id")) * n).cast("long") + begin).alias("id"))


def interval_draws(spark: SparkSession, n: int, k: int, m: int, s: int, seed: int = 0) -> DataFrame:
    """s draws with replacement from each interval of length k of [0, n), m times: stratum, sample, draw, id."""
    strata = -(-n // k)
    cell = spark.range(m * s * strata).withColumn("stratum", (F.col("id") / (m * s)).cast("long"))
    width = F.least(F.lit(k), F.lit(n) - F.col("stratum") * k)
    return cell.select("stratum", F.pmod((F.col("id") / s).cast("long"), F.lit(m)).alias("sample"), F.pmod(F.col("id"), F.lit(s)).alias("draw"), (F.floor(uniform(seed, F.col("id")) * width).cast("long") + F.col("stratum") * k).alias("id"))


def line_sample(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """A uniform sample of k rows: the top k by an MD5 of the row's values, k rows a partition at most. Equal rows stand or fall together, up to k."""
    key = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]))
    return df.withColumn("_r", key).orderBy("_r").limit(k).drop("_r")


def medoids(df: DataFrame, m: int, tables: int, seed: int = 0, id_col: str = "id", vec_col: str = "vec", order: Column | None = None) -> tuple[list, np.ndarray, np.ndarray]:
    """m rows for each table: their ids, the matrix of the distinct ones, and for each draw its row there.

    m * tables rows come to the driver.
    """
    drawn = sample_rows(df, tables, m, seed, id_col, order).join(df.select(id_col, vec_col), id_col).select("sample", F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).toArrow().sort_by([("sample", "ascending"), ("id", "ascending")])
    ids = drawn["id"].to_pylist()
    unique = sorted(set(ids))
    place = {x: k for k, x in enumerate(unique)}
    vectors = dict(zip(ids, drawn["vec"].to_pylist(), strict=True))
    return ids, np.array([vectors[x] for x in unique]), np.array([place[x] for x in ids]).reshape(tables, -1)
