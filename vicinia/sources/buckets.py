"""The bucket table of a hash index: (table_id, bucket, id), in memory or as Parquet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("table_id", "bucket", "id")


class BucketStore:
    """Appendable multimaps, one a table.

    ``parquet`` keeps a folder a table, so a table is read or cleared alone. Rows are
    dealt by range of (table, bucket, id) over as many partitions as the session's
    shuffles have, so a hot bucket falls into several files, and files' statistics narrow
    a read of one bucket.
    """

    def __init__(self, spark: SparkSession, kind: str = "memory", path: str | None = None):
        if kind not in ("memory", "parquet"):
            raise NotImplementedError(f"no store of kind {kind!r}")
        if (kind == "parquet") != (path is not None):
            raise ValueError("a path goes with kind parquet")
        self.spark, self.kind = spark, kind
        self.path = self._free(path) if path else None
        self._rows: DataFrame | None = None

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _free(self, path: str) -> str:
        """The first version folder that isn't there yet: a new index never overwrites one."""
        n = 0
        while True:
            fs, where = self._fs(f"{path}/v{n}")
            if not fs.exists(where):
                return f"{path}/v{n}"
            n += 1

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> BucketStore:
        """A store that was written before, by its version folder; of whichever layout it is."""
        from vicinia.sources.bucketed import BucketedStore

        if BucketedStore.is_at(spark, path):
            return BucketedStore.open(spark, path)
        out = cls(spark)
        out.kind, out.path = "parquet", path
        return out

    def append(self, rows: DataFrame, batch: str | None = None) -> BucketStore:
        """Add rows. A ``batch`` (Parquet only) has a folder of its own, and its rows take the place of those that an earlier attempt left there."""
        rows = rows.select(*COLUMNS)
        if self.kind == "parquet":
            dealt = rows.repartitionByRange("table_id", "bucket", "id").sortWithinPartitions("table_id", "bucket", "id")
            mode, where = ("append", self.path) if batch is None else ("overwrite", f"{self.path}-batches/batch={batch}")
            dealt.write.mode(mode).option("partitionOverwriteMode", "static").partitionBy("table_id").parquet(where)
        elif batch is not None:
            raise ValueError("batches need a store that outlives them: kind parquet")
        else:
            self._rows = rows if self._rows is None else self._rows.union(rows)
        return self

    def pack(self, hashes: DataFrame) -> BucketStore:
        """Append rows (id, keys): the key at place t is the bucket in table t."""
        return self.append(hashes.select("id", F.posexplode("keys").alias("table_id", "bucket")))

    def rows(self) -> DataFrame:
        if self.kind == "parquet":
            kept = [p for p in (self.path, f"{self.path}-batches") if (at := self._fs(p))[0].exists(at[1])]
            if kept:
                return reduce(DataFrame.union, [self.spark.read.parquet(p).select(*COLUMNS) for p in kept])
        elif self._rows is not None:
            return self._rows
        return self.spark.createDataFrame([], "table_id int, bucket long, id long")

    def bucket(self, table: int, key) -> DataFrame:
        """The ids of one bucket; table and key reach the scan."""
        return self.rows().where((F.col("table_id") == table) & (F.col("bucket") == key)).select("id")

    def met(self, hashes: DataFrame) -> DataFrame:
        """The queries' (query_id, table_id, bucket) with the ids in their buckets."""
        return hashes.join(self.rows(), ["table_id", "bucket"])

    def held(self, keys: DataFrame) -> DataFrame:
        """The rows in any of the buckets (table_id, bucket)."""
        return self.rows().hint("merge").join(keys.distinct(), ["table_id", "bucket"], "left_semi")

    def candidates(self, hashes: DataFrame) -> DataFrame:
        """Distinct (query_id, id) that share a bucket with the queries' (query_id, table_id, bucket)."""
        return self.met(hashes).select("query_id", "id").distinct()

    def candidate_counts(self, hashes: DataFrame) -> DataFrame:
        return self.met(hashes).groupBy("query_id").agg(F.count_distinct("id").alias("n"))

    def keys(self, table: int | None = None) -> DataFrame:
        rows = self.rows() if table is None else self.rows().where(F.col("table_id") == table)
        return rows.select("table_id", "bucket").distinct()

    def clear(self, tables: int | list[int] | None = None) -> BucketStore:
        tables = [tables] if isinstance(tables, int) else tables
        if self.kind == "parquet":
            for at in (self.path, f"{self.path}-batches", f"{self.path}-batches/batch=*"):
                for where in [at] if tables is None else [f"{at}/table_id={t}" for t in tables]:
                    fs, path = self._fs(where)
                    for found in fs.globStatus(path) or ():
                        fs.delete(found.getPath(), True)
        elif self._rows is not None:
            self._rows = None if tables is None else self._rows.where(~F.col("table_id").isin(tables))
        return self

    def copy(self) -> BucketStore:
        """A store with the same rows; appends to either don't show in the other."""
        if self.kind == "parquet":
            out = BucketStore(self.spark, "parquet", self.path.rsplit("/v", 1)[0])
            return out.append(self.rows())
        out = BucketStore(self.spark)
        out._rows = self._rows
        return out
