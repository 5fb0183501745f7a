"""A bucket store as a bucketed table: searches join it where it lies, without an exchange of the index.

Rows (table_id, bucket, part, id) are clustered by (table_id, bucket, part) into a fixed
number of file buckets and sorted within. A join on these three columns moves the queries
alone. Columns have the types of the first rows; later ones and queries are cast to them. A bucket that holds more than a file bucket's share of the rows (and ``least``) is
hot: its ids are dealt into parts, which lie in file buckets of their own, and queries ask
for each of its parts.

Of one append at most as many buckets as there are file buckets hold more than such a
share, so the list that is broadcast while writing has a proven bound. The lists of all
appends are a table beside the rows; a bucket has the most parts that any append gave it.

The table lies in a folder, and its layout beside it, so any session can open it; the
session's catalog learns it under a name made from the path.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinia.sources.buckets import COLUMNS, BucketStore
from vicinia.sources.workspace import Workspace

CLUSTER = ("table_id", "bucket", "part")
#: Rows that a bucket has at least before it is dealt into parts.
LEAST = 100_000


class BucketedStore(BucketStore):
    """``buckets``: file buckets, as many as the session's shuffles have partitions unless given."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, least: int = LEAST):
        super().__init__(spark, "parquet", path)
        self.buckets, self.least = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), least
        self._types: dict[str, str] | None = None  # those of the first rows

    @classmethod
    def is_at(cls, spark: SparkSession, path: str) -> bool:
        fs, where = BucketStore(spark)._fs(f"{path}-layout")
        return fs.exists(where)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> BucketedStore:
        out = object.__new__(cls)
        BucketStore.__init__(out, spark)
        layout = spark.read.parquet(f"{path}-layout").first()
        out.kind, out.path = "parquet", path
        out.buckets, out.least, out._types = layout["buckets"], layout["least"], dict(layout["types"])
        return out

    def table(self) -> str:
        """The catalog's name of the table, which a session that doesn't know it is told."""
        name = f"buckets_{hashlib.md5(self.path.encode()).hexdigest()}"
        if self.spark.catalog.tableExists(name):
            self.spark.catalog.refreshTable(name)
        else:
            where = self.path.replace("\\", "\\\\").replace("'", "\\'")
            self.spark.sql(
                f"CREATE TABLE {name} (table_id {self._types['table_id']}, bucket {self._types['bucket']}, part INT, id {self._types['id']}) USING parquet"
                f" CLUSTERED BY ({', '.join(CLUSTER)}) SORTED BY (table_id, bucket, id) INTO {self.buckets} BUCKETS LOCATION '{where}'"
            )
        return name

    def _write(self, rows: DataFrame, overwrite: bool = False) -> None:
        """Rows (table_id, bucket, part, id), a file for each file bucket."""
        rows = rows.select(*CLUSTER, "id").repartition(self.buckets, *CLUSTER)
        rows.write.insertInto(self.table(), overwrite=overwrite)

    def append(self, rows: DataFrame, batch: str | None = None) -> BucketedStore:
        if batch is not None:
            raise ValueError("a stream's batches go to a plain Parquet store; append its rows to a bucketed one")
        ws = Workspace(self.spark, "bucketed")
        rows = ws.save(rows.select(*COLUMNS), "rows")
        if self._types is None:
            self._types = dict(rows.dtypes)
            self.spark.createDataFrame([(self.buckets, self.least, self._types)], "buckets int, least long, types map<string,string>").coalesce(1).write.parquet(f"{self.path}-layout")
        share = max(self.least, rows.count() / self.buckets)
        hot = rows.groupBy("table_id", "bucket").count().where(F.col("count") > share)
        hot = ws.save(hot.select("table_id", "bucket", F.ceil(F.col("count") / share).cast("int").alias("parts")), "hot")
        hot.coalesce(1).write.mode("append").parquet(f"{self.path}-hot")
        dealt = rows.join(F.broadcast(hot), ["table_id", "bucket"], "left")  # as many rows as file buckets at most
        self._write(dealt.withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")))
        ws.drop("rows")
        return self

    def parts(self) -> DataFrame:
        """The hot buckets: table_id, bucket, parts."""
        return self.spark.read.parquet(f"{self.path}-hot").groupBy("table_id", "bucket").agg(F.max("parts").alias("parts"))

    def _whole(self) -> DataFrame | None:
        return None if self._types is None else self.spark.table(self.table())

    def rows(self) -> DataFrame:
        whole = self._whole()
        return super().rows().limit(0) if whole is None else whole.select(*COLUMNS)

    def met(self, hashes: DataFrame) -> DataFrame:
        if (whole := self._whole()) is None:
            return super().met(hashes)
        return self._in_parts(hashes).join(whole.hint("merge"), list(CLUSTER)).drop("part")

    def held(self, keys: DataFrame) -> DataFrame:
        if (whole := self._whole()) is None:
            return super().held(keys)
        return whole.hint("merge").join(self._in_parts(keys.distinct()), list(CLUSTER), "left_semi").select(*COLUMNS)

    def _in_parts(self, asked: DataFrame) -> DataFrame:
        """Rows (table_id, bucket), one for each part of the bucket."""
        asked = asked.withColumns({c: F.col(c).cast(self._types[c]) for c in ("table_id", "bucket")}).join(self.parts(), ["table_id", "bucket"], "left")
        return asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")

    def clear(self, tables: int | list[int] | None = None) -> BucketedStore:
        """Tables share files, so what stays is written aside and put in the place of all."""
        if (whole := self._whole()) is not None:
            ws = Workspace(self.spark, "bucketed")
            tables = [tables] if isinstance(tables, int) else tables
            self._write(ws.save(whole.limit(0) if tables is None else whole.where(~F.col("table_id").isin(tables)), "kept"), overwrite=True)
            ws.drop("kept")
        return self

    def copy(self) -> BucketedStore:
        out = BucketedStore(self.spark, self.path.rsplit("/v", 1)[0], self.buckets, self.least)
        return out if self._types is None else out.append(self.rows())
