"""Tables of vectors: adapters, scans, ids and partitions.

A dataset is a DataFrame with an id column and an array column. Ids that a source lacks
are given by an explicit order, so they are the same on every run.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePath

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinia.sources import arrays


#: Adapters by the type of what they adapt; a type without one takes the nearest of its base classes.
ADAPTERS: dict[type, Callable[..., DataFrame]] = {}


def adapts(kind: type) -> Callable:
    """Register ``make(spark, data, id_col, vec_col)`` as the adapter of a type; a later one takes an earlier one's place."""

    def register(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        ADAPTERS[kind] = make
        return make

    return register


def wrap(spark: SparkSession, data, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """A DataFrame as it is, a 2-D array with its row numbers as ids, a path by its files' kind, other types by their adapters."""
    for kind in type(data).__mro__:
        if kind in ADAPTERS:
            return ADAPTERS[kind](spark, data, id_col, vec_col)
    raise NotImplementedError(f"no adapter for {type(data).__name__}")


@adapts(DataFrame)
def _frame(spark: SparkSession, data: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return data


@adapts(np.ndarray)
def _array(spark: SparkSession, data: np.ndarray, id_col: str, vec_col: str) -> DataFrame:
    if data.ndim == 1:
        data = data.reshape(1, -1)
    if data.ndim != 2:
        raise ValueError("data must have two dimensions")
    flat = np.ascontiguousarray(data, dtype=np.float64)
    offsets = np.arange(0, flat.size + 1, max(1, flat.shape[1]), dtype=np.int64)
    vec = pa.LargeListArray.from_arrays(offsets[: len(flat) + 1], pa.array(flat.ravel()))
    return spark.createDataFrame(pa.table({id_col: np.arange(len(flat)), vec_col: vec}))


@adapts(PurePath)
def _path(spark: SparkSession, data: PurePath, id_col: str, vec_col: str) -> DataFrame:
    rows = spark.read.parquet(str(data)).select(id_col, vec_col) if data.suffix == ".parquet" else npy(spark, str(data))
    return rows.toDF(id_col, vec_col)


def parquet(spark: SparkSession, path: str, id_col: str, vec_col: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))


def npy(spark: SparkSession, path: str) -> DataFrame:
    """An ``.npy`` file or a folder of them, in tasks of row ranges; ids follow the order of files and rows."""
    return arrays.read(spark, path)


def raw(spark: SparkSession, path: str, dim: int, dtype: str = "<f8") -> DataFrame:
    """Rows of ``dim`` numbers in binary files without a header, in tasks of row ranges; ids follow the order of files and rows."""
    return arrays.read(spark, path, dim=dim, dtype=dtype)


def delimited(spark: SparkSession, path: str, dim: int, header: bool = False, rownames: bool = False, sep: str = "\t") -> DataFrame:
    """Numbers in delimited texts; row names, if any, become string ids, else ids follow the order of file names, and of the lines in each."""
    names = (["name string"] if rownames else []) + [f"c{i} double" for i in range(dim)]
    rows = spark.read.csv(path, schema=", ".join(names), sep=sep, header=header, mode="FAILFAST")
    vec = F.array(*[F.col(f"c{i}") for i in range(dim)]).alias("vec")
    if rownames:
        return rows.select(F.col("name").alias("id"), vec)
    # within a block of a file the rows of a partition are in order, whichever partition Spark deals the block to
    line = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return with_ids(rows.select(vec, line.alias("_line")), F.col("_line")).select("id", "vec")


def with_ids(df: DataFrame, order: Column, id_col: str = "id") -> DataFrame:
    """Number rows from 0 in an explicit order; the order is sorted by range, one count a partition is gathered."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.select("*", order.alias("_order")).repartitionByRange(n, "_order").sortWithinPartitions("_order")
    placed = ordered.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_local"))
    if spark.sparkContext.getCheckpointDir():
        placed = placed.checkpoint()  # places must not change if a task is run again
    counts = placed.groupBy("_part").count().toArrow().sort_by("_part")
    n = counts["count"].to_numpy()
    starts = spark.createDataFrame(pa.table({"_part": counts["_part"], "_start": n.cumsum() - n}))
    return placed.join(F.broadcast(starts), "_part").withColumn(id_col, F.col("_start") + F.col("_local")).drop("_part", "_local", "_start", "_order")


def by_range(df: DataFrame, begin: int, end: int, id_col: str = "id") -> DataFrame:
    """Rows with begin <= id < end; the bounds reach the scan."""
    return df.where((F.col(id_col) >= begin) & (F.col(id_col) < end))


def by_id(df: DataFrame, ids: DataFrame | list, id_col: str = "id") -> DataFrame:
    """Rows of the given ids, a list or a table with the id column."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(id_col).distinct(), id_col, "left_semi")
    return df.where(F.col(id_col).isin(list(ids)))


def blocks(df: DataFrame, workers: int, max_size: int | None = None) -> DataFrame:
    """The rows in ``workers`` partitions, or more where a partition would hold over ``max_size`` of them."""
    return df.repartition(workers if max_size is None else max(workers, -(-df.count() // max_size)))


def are_indices(df: DataFrame, id_col: str = "id") -> bool:
    """Whether the ids are 0 .. n - 1, each once."""
    n, low, high, different = df.agg(F.count("*"), F.min(id_col), F.max(id_col), F.count_distinct(id_col)).first()
    return n == 0 or (low == 0 and high == n - 1 and different == n)


def shape(df: DataFrame, vec_col: str = "vec") -> tuple[int, int]:
    """Rows and dimensions; rows of several lengths fail."""
    n, low, high = df.agg(F.count("*"), F.min(F.size(vec_col)), F.max(F.size(vec_col))).first()
    if low != high:
        raise ValueError(f"vectors have from {low} to {high} dimensions")
    return n, high or 0


def checked_dim(df: DataFrame, dim: int, vec_col: str = "vec") -> DataFrame:
    """Fail at run time on a vector of another dimension."""
    size = F.size(vec_col)
    many = F.raise_error(F.concat(F.lit("too many numbers in a vector: "), size)).cast("array<double>")
    few = F.raise_error(F.concat(F.lit("missing numbers in a vector: "), size)).cast("array<double>")
    return df.withColumn(vec_col, F.when(size > dim, many).when(size < dim, few).otherwise(F.col(vec_col)))
