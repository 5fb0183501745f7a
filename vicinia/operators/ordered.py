"""As-of join: each row of one table meets the latest row of another at or before its place.

Both tables are dealt by range of (keys, place) in one exchange and written, so a key that
holds a third of all rows is split over many partitions. The last right row before each
range is carried into it as one more row (one a range), and a running window fills in
within each range and key. Nothing is broadcast and no pairs are formed.

Defined cases: of right rows at one place the one with the greatest ``tie`` counts (a null
tie is least; of equal ties any of equal rows, or else the greatest row by hash); a left row whose keys or
place are null meets nothing and stays; such right rows are left out; a left row without
an earlier right row in its keys (or within ``within``) gets a null; repeated left rows
stay repeated; empty tables give an empty or unmatched result. The columns of both tables
travel in structs, so their names may clash; a left column named like ``out`` is replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinia.sources.workspace import Workspace


def as_of(left: DataFrame, right: DataFrame, by: list[str], on: str, tie: str, within: Column | None = None, out: str = "met") -> DataFrame:
    """The left table with a struct ``out``: the latest right row with equal ``by`` and ``on`` not later, at most ``within`` before."""
    spark = left.sparkSession
    ws = Workspace(spark, "as-of")
    left = left.drop(out)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*by, on]])
    key = lambda df: F.struct(F.lit(0).alias("all"), *[F.col(c).cast(left.schema[c].dataType).alias(f"k{i}") for i, c in enumerate(by)]).alias("k")
    row = lambda df: F.struct(*[F.col(c) for c in df.columns])
    lefts = left.where(known).select(key(left), F.col(on).alias("t"), F.lit(1).alias("side"), F.lit(None).cast(right.schema[tie].dataType).alias("tie"), F.xxhash64(F.to_json(row(left))).alias("spread"), row(left).alias("l"))
    rights = right.where(known).select(key(right), F.col(on).cast(left.schema[on].dataType).alias("t"), F.lit(0).alias("side"), F.col(tie).alias("tie"), F.xxhash64(F.to_json(row(right))).alias("spread"), row(right).alias("r"))
    order = ["t", "side", "tie", "spread"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lefts.unionByName(rights, allowMissingColumns=True).repartitionByRange(n, "k", *order)
    placed = ws.save(dealt.withColumn("part", F.spark_partition_id()), "placed")
    lasts = placed.where("side = 0").groupBy("part").agg(F.max(F.struct("k", *order)).alias("at"), F.max_by("r", F.struct("k", *order)).alias("r"))
    # one row a range: those without a right row pass the one before on
    ranges = spark.range(n).select(F.col("id").cast("int").alias("part")).join(lasts, "part", "left")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select("part", F.last("at", ignorenulls=True).over(before).alias("at"), F.last("r", ignorenulls=True).over(before).alias("r")).where("at is not null")
    whole = placed.unionByName(carried.select("part", "at.*", "r"), allowMissingColumns=True)
    latest = F.last("r", ignorenulls=True).over(Window.partitionBy("part", "k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    met = whole.withColumn("m", latest).where("side = 1")
    if within is not None:
        met = met.withColumn("m", F.when(F.col("m")[on].cast(left.schema[on].dataType) >= F.col("t") - within, F.col("m")))
    found = met.select(*[F.col("l")[c].alias(c) for c in left.columns], F.col("m").alias(out))
    return found.unionByName(left.where(~known).withColumn(out, F.lit(None).cast(found.schema[out].dataType)))
