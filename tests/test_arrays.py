"""Array files in ranges of rows: layouts, kinds, folders, writing, failures."""

import json

import numpy as np
import pyarrow as pa
import pytest

from vicinia.sources import arrays, vectors


def rows(df):
    return sorted((r.id, list(r.vec)) for r in df.collect())


def numbered(a):
    return [(i, v) for i, v in enumerate(np.asarray(a, float).tolist())]


@pytest.mark.parametrize("kind", ["<f8", ">f4", "<i2", "?", "<f2"])
@pytest.mark.parametrize("order", ["C", "F"])
def test_one_file_is_many_tasks(spark, tmp_path, kind, order):
    a = np.random.default_rng(1).integers(0, 2, (1000, 7)).astype(kind)
    np.save(tmp_path / "a.npy", np.asarray(a, order=order))
    df = arrays.read(spark, str(tmp_path / "a.npy"), split_bytes=100 * 7 * a.itemsize)
    assert df.rdd.getNumPartitions() == 10 and rows(df) == numbered(a)


def test_batches_within_a_task(spark, tmp_path, monkeypatch):
    a = np.random.default_rng(2).random((50, 300))
    np.save(tmp_path / "a.npy", a)
    source = arrays.ArrayReader({"path": f"file:{tmp_path}/a.npy", "split_bytes": str(20 * 2400)})
    monkeypatch.setattr(arrays, "BATCH_BYTES", 6 * 2400)
    parts = [list(source.read(p)) for p in source.partitions()]
    assert [[len(b) for b in p] for p in parts] == [[6, 6, 6, 2], [6, 6, 6, 2], [6, 4]]
    back = pa.Table.from_batches([b for p in parts for b in p])
    assert back["id"].to_pylist() == list(range(50)) and np.array_equal(np.array(back["vec"].to_pylist()), a)


def test_shapes(spark, tmp_path):
    for name, a, want in (("one", np.arange(4), [(0, [0.0, 1.0, 2.0, 3.0])]), ("none", np.empty((0, 3)), []), ("number", np.float64(7), [(0, [7.0])]), ("wide", np.empty((2, 0)), [(0, []), (1, [])])):
        np.save(tmp_path / f"{name}.npy", a)
        assert rows(vectors.npy(spark, str(tmp_path / f"{name}.npy"))) == want
    for name, a, match in (("deep", np.zeros((2, 2, 2)), "dimensions"), ("words", np.array([["a"]]), "numbers are needed"), ("complex", np.zeros((2, 2), complex), "numbers are needed")):
        np.save(tmp_path / f"{name}.npy", a)
        with pytest.raises(Exception, match=match):
            vectors.npy(spark, str(tmp_path / f"{name}.npy")).collect()
    with pytest.raises(Exception, match="absent"):
        vectors.npy(spark, str(tmp_path / "absent.npy")).collect()


def test_folders_and_records(spark, tmp_path):
    a = np.random.default_rng(3).random((30, 4))
    for name, part in (("b", a[20:]), ("a", a[:20]), ("_hidden", a)):
        np.save(tmp_path / f"{name}.npy", part)
        (tmp_path / "raw").mkdir(exist_ok=True)
        part.astype("<f4").tofile(tmp_path / "raw" / name)
    assert rows(vectors.npy(spark, str(tmp_path))) == numbered(a)
    assert rows(vectors.raw(spark, str(tmp_path / "raw"), 4, "<f4")) == numbered(a.astype("<f4"))
    with pytest.raises(Exception, match="whole number"):
        vectors.raw(spark, str(tmp_path / "raw" / "a"), 7).collect()


def test_write_and_read(spark, tmp_path):
    a = np.random.default_rng(4).random((500, 5))
    df = vectors.wrap(spark, a).selectExpr("id * 3 as id", "vec").repartition(5)
    path = f"file://{tmp_path}/out"
    arrays.write(df, path, part_bytes=37 * 40)
    (tmp_path / "out" / "part-of-a-lost-attempt.npy").write_bytes(b"")
    assert rows(vectors.npy(spark, path)) == numbered(a)
    parts = json.loads((tmp_path / "out" / arrays.LIST).read_text())
    assert max(p["rows"] for p in parts) == 37 and sum(p["rows"] for p in parts) == 500
    assert np.array_equal(np.concatenate([np.load(tmp_path / "out" / p["path"]) for p in parts]), a)  # plain readers take the parts
    with pytest.raises(Exception, match="overwrite"):
        arrays.write(df, path)
    arrays.write(df.limit(0), path, mode="overwrite")
    assert rows(vectors.npy(spark, path)) == []
    for i, (bad, match) in enumerate(((["array(1D)", "array(1D, 2D)"], "numbers in one array"), (["array(1D, null)"], "a null"), (["cast(null as array<double>)"], "a null"))):
        frame = spark.sql(" union all ".join(f"select {k}L as id, {v} as vec" for k, v in enumerate(bad)))
        with pytest.raises(Exception, match=match):
            arrays.write(frame, f"{path}-{i}")
        assert not (tmp_path / f"out-{i}" / arrays.LIST).exists()


def test_adapters(spark, tmp_path):
    class Grid:
        side = 3

    class Finer(Grid):
        side = 4

    with pytest.raises(NotImplementedError):
        vectors.wrap(spark, Grid())
    try:

        @vectors.adapts(Grid)
        def grid(spark, data, id_col, vec_col):
            return spark.range(data.side**2).selectExpr(f"id as {id_col}", f"array(double(id % {data.side}), double(id div {data.side})) as {vec_col}")

        assert rows(vectors.wrap(spark, Finer())) == [(i, [i % 4, i // 4]) for i in range(16)]
        assert vectors.wrap(spark, Grid(), "a", "b").columns == ["a", "b"]
    finally:
        vectors.ADAPTERS.pop(Grid, None)
    np.save(tmp_path / "a.npy", np.eye(3))
    assert vectors.wrap(spark, tmp_path / "a.npy", "a", "b").columns == ["a", "b"] and rows(vectors.wrap(spark, tmp_path / "a.npy")) == numbered(np.eye(3))
