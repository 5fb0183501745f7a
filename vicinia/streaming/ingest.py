"""Index maintenance from a stream of points: each micro-batch is hashed and added to the bucket store."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vicinia.plans.families import Family
from vicinia.sources.buckets import BucketStore


def run_name(spark: SparkSession, checkpoint: str) -> str:
    """A name that lives and goes with the stream's checkpoint, so batch numbers that begin anew don't meet older ones."""
    where = f"{checkpoint.rstrip('/')}/vicinia-run"
    fs, path = BucketStore(spark)._fs(where)
    if not fs.exists(path):
        spark.createDataFrame([(uuid.uuid4().hex,)], "name string").coalesce(1).write.parquet(where)
    return spark.read.parquet(where).first()["name"]


def adder(family: Family, store: BucketStore, run: str) -> Callable[[DataFrame, int], None]:
    """What a stream does with a batch. The batch's folder is written anew by each attempt, so a batch that is run again leaves the same rows."""

    def add(batch: DataFrame, number: int) -> None:
        store.append(family.hashed(batch), batch=f"{run}-{number}")

    return add


def index_stream(points: DataFrame, family: Family, store: BucketStore, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Hashing needs no state, so batches are independent; each counts once, whatever failed before it was done."""
    if store.kind != "parquet" or type(store) is not BucketStore:
        raise ValueError("a stream needs a store whose batches have folders: kind parquet")
    writer = points.writeStream.foreachBatch(adder(family, store, run_name(points.sparkSession, checkpoint))).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
