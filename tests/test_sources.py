import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinia.sources import vectors
from vicinia.sources.buckets import BucketStore


def test_adapters(spark, tmp_path):
    a = np.arange(12.0).reshape(4, 3)
    df = vectors.wrap(spark, a)
    assert vectors.wrap(spark, df) is df
    rows = lambda d: sorted((r.id, list(r.vec)) for r in d.collect())
    want = [(i, v) for i, v in enumerate(a.tolist())]
    assert rows(df) == want and vectors.shape(df) == (4, 3) and vectors.are_indices(df)
    assert vectors.shape(vectors.wrap(spark, a[0])) == (1, 3)
    with pytest.raises(NotImplementedError):
        vectors.wrap(spark, "a path")
    np.save(tmp_path / "a.npy", a)
    assert rows(vectors.npy(spark, str(tmp_path / "a.npy"))) == want
    a.tofile(tmp_path / "a.dat")
    assert rows(vectors.raw(spark, str(tmp_path / "a.dat"), 3)) == want
    (tmp_path / "a.txt").write_text("n\tx\ty\tz\n" + "".join(f"r{i}\t" + "\t".join(map(str, v)) + "\n" for i, v in want))
    assert sorted(r.id for r in vectors.delimited(spark, str(tmp_path / "a.txt"), 3, header=True, rownames=True).collect()) == ["r0", "r1", "r2", "r3"]
    (tmp_path / "b.txt").write_text("".join(",".join(map(str, v)) + "\n" for _, v in want))
    assert rows(vectors.delimited(spark, str(tmp_path / "b.txt"), 3, sep=",")) == want


def test_lines_of_several_files(spark, tmp_path):
    """Ids follow the names of the files, whatever their sizes, and the lines in each."""
    lines = 0
    for name, n in (("a", 3), ("b", 400), ("c", 40)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{lines + i}\t{i}\n" for i in range(n)))
        lines += n
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = vectors.delimited(spark, f"{tmp_path}/*.txt", 2).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.id, int(r.vec[0])) for r in got) == [(i, i) for i in range(lines)]
    assert vectors.blocks(spark.range(100), 3, 20).rdd.getNumPartitions() == 5 and vectors.blocks(spark.range(100), 3).rdd.getNumPartitions() == 3


def test_gathering(spark):
    df = spark.range(50).select("id", F.array(F.col("id").cast("double")).alias("vec"))
    assert [r.id for r in vectors.by_range(df, 10, 13).collect()] == [10, 11, 12]
    assert sorted(r.id for r in vectors.by_id(df, [3, 99, 7]).collect()) == [3, 7]
    assert sorted(r.id for r in vectors.by_id(df, spark.createDataFrame([(3,), (3,), (60,)], "id long")).collect()) == [3]
    numbered = vectors.with_ids(df.select((F.col("id") * -2).alias("x")), F.col("x")).collect()
    assert sorted((r.id, r.x) for r in numbered) == [(i, 2 * i - 98) for i in range(50)]
    assert not vectors.are_indices(df.where("id <> 4"))
    mixed = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, vec array<double>")
    with pytest.raises(ValueError, match="dimensions"):
        vectors.shape(mixed)
    for dim, match in ((1, "too many"), (2, "missing")):
        with pytest.raises(Exception, match=match):
            vectors.checked_dim(mixed, dim).collect()


@pytest.mark.parametrize("kind", ["memory", "parquet"])
@pytest.mark.parametrize("id_type", ["long", "string"])
def test_bucket_store(spark, tmp_path, kind, id_type):
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2, (10, 4)).tolist()
    name = (lambda i: i) if id_type == "long" else (lambda i: f"a-b-{i}")
    df = spark.createDataFrame([(name(i), k) for i, k in enumerate(keys)], f"id {id_type}, keys array<long>")
    path = f"file://{tmp_path}/index" if kind == "parquet" else None
    store = BucketStore(spark, kind, path).pack(df)
    for t in range(4):
        for k in (0, 1, 2):
            assert {r.id for r in store.bucket(t, k).collect()} == {name(i) for i in range(10) if keys[i][t] == k}
    asked = spark.createDataFrame([(0, t, 1) for t in range(4)], "query_id long, table_id int, bucket long")
    want = {name(i) for i in range(10) if any(keys[i])}
    assert {r.id for r in store.candidates(asked).collect()} == want
    assert [r.n for r in store.candidate_counts(asked).collect()] == [len(want)]
    assert {(r.table_id, r.bucket) for r in store.keys().collect()} == {(t, k[t]) for k in keys for t in range(4)}
    assert {r.bucket for r in store.keys(2).collect()} == {k[2] for k in keys}
    other = store.copy()
    store.clear(1)
    assert {r.table_id for r in store.rows().select("table_id").distinct().collect()} == {0, 2, 3} and other.rows().count() == 40
    store.clear()
    assert store.rows().count() == 0
    if kind == "parquet":
        assert other.path.endswith("/v1") and BucketStore.open(spark, other.path).rows().count() == 40
        assert BucketStore(spark, kind, path).path not in (other.path,)
    store.pack(df)
    assert store.rows().count() == 40


def test_store_arguments(spark):
    with pytest.raises(NotImplementedError):
        BucketStore(spark, "redis")
    with pytest.raises(ValueError, match="path"):
        BucketStore(spark, "parquet")
