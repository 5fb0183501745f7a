"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where it is unset a folder is made on this machine, for local masters only: executors
    of a cluster would each write to a disk of their own.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not (own := spark.conf.get("vicinia.local.checkpoint.dir", None)):
        own = "file://" + tempfile.mkdtemp(prefix="vicinia-")
        spark.conf.set("vicinia.local.checkpoint.dir", own)
    return own


class Workspace:
    """Written intermediate tables of one operator call.

    A table cuts the lineage: it survives a lost executor and it is never computed
    twice. Tables go when the process ends, or earlier through ``drop``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/vicinia/{name}-{uuid.uuid4().hex}"
        if not _written:
            atexit.register(_clean)
        _written.append((spark, self.root))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        delete(self.spark, f"{self.root}/{name}")


def delete(spark: SparkSession, path: str) -> None:
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(hadoop).delete(where, True)


def _clean() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            delete(spark, path)
