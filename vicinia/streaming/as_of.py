"""As-of join within a stream: each left row with its key's latest right row at or before it, in event time.

Rows wait in their key's state until the watermark passes them, and then go through in
order of time, right rows before left ones of the same time, so what a row meets doesn't
depend on the order of arrival. A key's state is its last right row and the rows of the
watermark's delay; a timer stands at the earliest of them. All rows of a key within the delay
pass one task (a key is one place in the state store), which must hold them at once.

Defined cases: a row behind the watermark is late and dropped, left or right, and the
stream's tail stays in state until the watermark passes it; of right rows at one time the
greatest id counts (a null id is least); left rows without an earlier right row get nulls;
rows whose time or key is null, or which are neither side, are left out and move no watermark; repeated left
rows stay repeated; ids and keys are carried as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timers(spark: SparkSession):
    """Streams that are started within keep state in RocksDB, which timers need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class _AsOf(StatefulProcessor):
    """State of a key: rows (at, left, id) that wait, and the last right row that went through; times are microseconds."""

    def __init__(self, id_type: T.DataType):
        self.id_type = id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        at, own = T.StructField("at", T.LongType()), T.StructField("id", self.id_type)
        self.handle = handle
        self.waiting = handle.getListState("waiting", T.StructType([at, T.StructField("left", T.BooleanType()), own]))
        self.last = handle.getValueState("last", T.StructType([at, own]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["at"], r["left"], r["id"]) for r in rows]
        self.waiting.appendList(new)
        self.handle.registerTimer(min(at for at, _, _ in new) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], r[1], (False,) if r[2] is None else (True, r[2])))
        rest = [r for r in waiting if r[0] > passed]
        if len(rest) == len(waiting):
            return
        last = tuple(self.last.get()) if self.last.exists() else None
        for at, left, own in waiting[: len(waiting) - len(rest)]:
            if left:
                yield Row(key=key[0], at=at, id=own, met_at=last and last[0], met_id=last and last[1])
            else:
                last = (at, own)
        if last:
            self.last.update(last)
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000)

    def close(self) -> None:
        pass


def as_of_stream(events: DataFrame, by: str, on: str, own: str, left: Column, right: Column, delay: str) -> DataFrame:
    """(``by``, ``on``, ``own``, met_``on``, met_``own``) of the left rows; ``own`` names the id, ``delay`` how late a row may come.

    Start it within ``timers``; its output mode is append.
    """
    key, when, name = (events.schema[c].dataType for c in (by, on, own))
    plain = isinstance(when, T.TimestampNTZType)  # counted from its own epoch, whatever the session's zone
    epoch = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
    micros = F.expr(f"cast(cast(cast(`{on}` - {epoch} as interval second) as decimal(20, 6)) * 1000000 as bigint)") if plain else F.unix_micros(on)
    back = lambda c: F.expr(f"{epoch} + {c} * interval '0.000001' second" if plain else f"timestamp_micros({c})")
    sides = F.array_compact(F.array(F.when(right, False), F.when(left, True)))  # a row may be both
    rows = events.select(F.col(by).alias("key"), micros.alias("at"), F.col(own).alias("id"), sides.alias("sides")).where("key is not null and at is not null and size(sides) > 0")
    rows = rows.withColumn("time", F.timestamp_micros("at")).withWatermark("time", delay).select("key", "time", "at", "id", F.explode("sides").alias("left"))
    out = T.StructType([T.StructField("key", key), T.StructField("at", T.LongType()), T.StructField("id", name), T.StructField("met_at", T.LongType()), T.StructField("met_id", name)])
    met = rows.groupBy("key").transformWithState(_AsOf(name), out, "Append", "EventTime")
    return met.select(F.col("key").alias(by), back("at").alias(on), F.col("id").alias(own), back("met_at").alias(f"met_{on}"), F.col("met_id").alias(f"met_{own}"))
