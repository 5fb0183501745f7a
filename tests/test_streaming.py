"""Streams: batches that are run again, late rows, state over restarts."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vicinia.plans.families import Cosine
from vicinia.sources.bucketed import BucketedStore
from vicinia.sources.buckets import BucketStore
from vicinia.streaming.as_of import as_of_stream, timers
from vicinia.streaming.ingest import adder, index_stream, run_name


@pytest.fixture
def vecs(spark):
    rng = random.Random(2)
    return spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(80)] + [(0, [1.0] * 6)], "id long, vec array<double>")


def test_a_batch_that_is_run_again_leaves_the_same_rows(spark, vecs, tmp_path):
    family = Cosine.draw(6, L=3, k=4, seed=1)
    store = BucketStore(spark, "parquet", f"file://{tmp_path}/index").append(family.hashed(vecs.where("id >= 60")))
    add = adder(family, store, "a")
    add(vecs.where("id < 30"), 0)
    add(vecs.where("id between 30 and 59"), 1)
    want = Counter(store.rows().collect())
    assert sum(want.values()) == 3 * 81  # repeated ids stay repeated
    add(vecs.where("id between 30 and 59"), 1)
    assert Counter(store.rows().collect()) == want
    assert Counter(BucketStore.open(spark, store.path).rows().collect()) == want
    adder(family, store, "b")(vecs.where("id = 5"), 0)  # another run's batch 0 is another batch
    assert store.rows().count() == 3 * 82
    assert {r.table_id for r in store.clear(1).rows().collect()} == {0, 2} and store.clear().rows().count() == 0


def test_a_stream_that_fails_after_its_append(spark, vecs, tmp_path, monkeypatch):
    family, store = Cosine.draw(6, L=2, k=4, seed=1), BucketStore(spark, "parquet", f"file://{tmp_path}/index")
    vecs.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(vecs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    append = BucketStore.append

    def fails(self, *args, **more):
        append(self, *args, **more)
        raise RuntimeError("lost after the write")

    monkeypatch.setattr(BucketStore, "append", fails)
    with pytest.raises(Exception, match="lost after the write"):
        index_stream(stream, family, store, f"file://{tmp_path}/progress", once=True).awaitTermination()
    monkeypatch.setattr(BucketStore, "append", append)
    assert 0 < store.rows().count() < 2 * 81
    index_stream(stream, family, store, f"file://{tmp_path}/progress", once=True).awaitTermination()
    assert Counter(store.rows().collect()) == Counter(family.hashed(vecs).select("table_id", "bucket", "id").collect())
    assert run_name(spark, f"file://{tmp_path}/progress") == run_name(spark, f"file://{tmp_path}/progress")
    with pytest.raises(ValueError, match="parquet"):
        index_stream(stream, family, BucketedStore(spark, f"file://{tmp_path}/other"), "unused")


BASE = dt.datetime(2024, 3, 31, 1, 30)  # an hour that some zones skip


def at(minutes):
    return BASE + dt.timedelta(minutes=minutes, microseconds=123_456)


def brute(rows, passed):
    """Left rows up to the watermark with their key's latest right row."""
    out = []
    for k, t, i, side in rows:
        if None in (k, t) or side not in ("l", "b") or t > passed:
            continue
        met = [(u, j is not None, j or 0, j) for key, u, j, s in rows if key == k and s in ("r", "b") and u is not None and u <= t]
        out.append((k, t, i, *((max(met)[0], max(met)[3]) if met else (None, None))))
    return Counter(out)


@pytest.mark.parametrize(("kind", "zone"), [("timestamp_ntz", "Europe/Paris"), ("timestamp", "UTC")])
def test_as_of_with_late_rows_and_restarts(spark, tmp_path, kind, zone):
    """Rows come up to 50 minutes late of the 60 that are allowed; some come far too late and are dropped."""
    rng = random.Random(3)
    spark.conf.set("spark.sql.session.timeZone", zone)
    schema = f"key string, t {kind}, id long, side string"
    rows = [(rng.choice("aaaabc"), at(10 * (n // 4) - rng.randrange(50)), rng.choice((n, n, n, None)), rng.choice("lrlrbx")) for n in range(240)]
    batches = [rows[60 * b : 60 * b + 60] for b in range(4)]
    batches[0] += [rows[5], (None, at(3), 1, "l"), ("a", None, 2, "r")]
    batches[3] += [("d", at(520), 3, "l")]
    rows = sum(batches, [])
    batches[3] += [("a", at(-40), 900, "r"), ("e", at(-45), 901, "l")]  # far too late

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        met = as_of_stream(stream, "key", "t", "id", F.col("side").isin("l", "b"), F.col("side").isin("r", "b"), "60 minutes")
        with timers(spark):
            met.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        return spark.read.schema(met.schema).parquet(f"{tmp_path}/out")

    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if n in (1, 3):  # two runs of two batches each
            got = run()
    assert got.columns == ["key", "t", "id", "met_t", "met_id"] and dict(got.dtypes)["t"] == kind
    newest = max(r[1] for r in rows if r[1] and r[0] and r[3] != "x")
    passed = newest.replace(microsecond=123_000) - dt.timedelta(minutes=60)
    got = Counter(tuple(r) for r in got.collect())
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == brute(rows, passed) and sum(got.values()) > 80


def test_a_stream_without_rows(spark, tmp_path):
    spark.createDataFrame([], "key long, t timestamp, id long, side string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key long, t timestamp, id long, side string").parquet(f"{tmp_path}/in")
    met = as_of_stream(stream, "key", "t", "id", F.col("side") == "l", F.col("side") == "r", "1 minute")
    with timers(spark):
        met.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    assert spark.read.schema(met.schema).parquet(f"{tmp_path}/out").count() == 0
