import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinia.operators import blocks, pairs

ROWS = np.random.default_rng(3).random((600, 3))


@pytest.fixture(scope="module")
def one_file(spark):
    """More rows than a block has, in one partition."""
    return spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(ROWS)], "id long, vec array<double>").coalesce(1)


@pytest.mark.parametrize("metric", ["cityblock", lambda u, v: abs(u[0] - v[0])])
def test_a_product_of_one_file_is_dealt_over_tasks(one_file, metric):
    for df in (pairs.pairwise(one_file, one_file, metric), pairs.condensed(one_file, metric)):
        held = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        assert len(held) >= 4 and max(held) <= sum(held) / 2


def test_all_pairs_of_several_blocks(one_file):
    d = blocks.cdist("euclidean", ROWS, ROWS)
    got = np.full((600, 600), np.nan)
    for r in pairs.pairwise(one_file, one_file, "euclidean").collect():
        got[r.id_a, r.id_b] = r.distance
    np.testing.assert_allclose(got, d)
    assert {(r.id_a, r.id_b) for r in pairs.condensed(one_file, "euclidean").collect()} == {(i, j) for i in range(600) for j in range(i + 1, 600)}


def test_rows_without_a_vector_have_no_distance(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [4.0]), (4, [1.0, 4.0])], "id long, vec array<double>")
    got = {(r.id_a, r.id_b): r.distance for r in pairs.pairwise(df, df, "cityblock").collect()}
    assert len(got) == 25 and {k for k, d in got.items() if d is not None} == {(0, 0), (0, 4), (4, 0), (4, 4), (3, 3)}
    assert got[0, 4] == 2 and got[3, 3] == 0


def test_copies_tie_in_hausdorff(spark):
    rows = np.repeat(ROWS[:300], 2, axis=0)
    df = spark.createDataFrame([(k, r.tolist(), k % 2) for k, r in enumerate(rows)], "id long, vec array<double>, label int")
    got = {(r.label_a, r.label_b): (r.distance, r.id_a, r.id_b) for r in pairs.directed_hausdorff(df, df, by=["label"]).collect()}
    assert got == {(a, b): (0.0, a, b) for a in (0, 1) for b in (0, 1)}


def test_exact_neighbours_shuffle_the_best_of_each_task_only(one_file):
    from vicinia.plans import search

    few = one_file.where("id < 10")
    sent = search._best_in_blocks(few, one_file, 3, "euclidean", 3, {})
    tasks = sent.groupBy("query_id", F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert tasks <= 3 and sent.count() < 10 * 600 / 4
    d = blocks.cdist("euclidean", ROWS[:10], ROWS)
    want = {(i, k + 1): j for i in range(10) for k, j in enumerate(np.argsort(d[i], kind="stable")[:3])}
    assert {(r.query_id, r.rank): r.id for r in search.nearest_exact(few, one_file, 3).collect()} == want


def test_blocks_round_like_sql():
    import duckdb

    x = np.concatenate([np.random.default_rng(4).random(5000) * 9 - 2, [0.0078125, -0.0078125, -0.0, -1e-9, 5e-7, 2.0000005, np.nan, np.inf, 1e305]])
    want = [duckdb.execute("select round(?::double, 6) + 0.0", [v]).fetchone()[0] for v in x]
    np.testing.assert_array_equal(pairs.nearest_decimal(x, 6), want)
    assert not np.signbit(pairs.nearest_decimal(np.array([-0.0, -1e-9]), 6)).any()


def test_truth_values_are_counted_by_products():
    a, b = (ROWS[:40] > 0.5) * 1.0, (ROWS[40:90] > 0.5) * 1.0
    for name in ("jaccard", "hamming"):
        np.testing.assert_array_equal(blocks.cdist(name, a, b), blocks.cdist(name, 2 * a, 2 * b))
    np.testing.assert_allclose(blocks.cdist("canberra", [[0.0, 1.0, 0.0]], [[0.0, 3.0, 2.0]]), [[1.5]])


def test_condensed_measures_no_pair_of_blocks_twice(one_file):
    """Of two blocks one order only is measured, whatever order the rows lie in."""
    calls = one_file.sparkSession.sparkContext.accumulator(0)

    @pairs.broadcasting
    def counted(u, v):
        out = np.abs(u - v).sum(-1)
        calls.add(out.size)
        return out

    mixed = one_file.orderBy(F.xxhash64("id"))
    got = pairs.condensed(mixed, counted, places=3).collect()
    assert {(r.id_a, r.id_b) for r in got} == {(i, j) for i in range(600) for j in range(i + 1, 600)}
    assert calls.value <= 600 * 600 * 3 / 4
    assert all(r.distance == round(np.abs(ROWS[r.id_a] - ROWS[r.id_b]).sum() * 1000) / 1000 for r in got[:500])


#: Metrics of truth values whose products were found to fail by time.
COUNTED = ["kulsinski", "sokalmichener", "sokalsneath", "yule", "rogerstanimoto"]


@pytest.mark.parametrize("metric", COUNTED)
def test_a_product_of_truth_values_is_dealt_over_tasks(one_file, metric):
    truths = one_file.select("id", F.transform("vec", lambda x: F.when(x > 0.5, 1.0).otherwise(0.0)).alias("vec"))
    few = truths.where("id % 100 = 0")
    got = pairs.pairwise(few, truths, metric, places=6).withColumn("task", F.spark_partition_id()).collect()
    held = np.unique([r.task for r in got], return_counts=True)[1]
    assert len(held) >= 3 and held.max() <= len(got) / 2
    want = np.round(blocks.cdist(metric, (ROWS[::100] > 0.5) * 1.0, (ROWS > 0.5) * 1.0), 6)
    assert len(got) == want.size
    np.testing.assert_allclose([r.distance for r in got], [want[r.id_a // 100, r.id_b] for r in got], atol=1e-6)


@pytest.mark.parametrize("metric", COUNTED)
def test_a_block_takes_the_ratio_that_is_asked_for_only(metric):
    """The answer and the counts of a part of the rows are held; all metrics' ratios took some twenty blocks."""
    a, b = (np.random.default_rng(k).random((256, 64)) > 0.5 for k in (6, 7))
    tracemalloc.start()
    d = blocks.cdist(metric, a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * d.nbytes


@pytest.mark.parametrize("held", [1 << 28, 1 << 13])
def test_hausdorff_leaves_rows_that_cannot_be_the_farthest(one_file, monkeypatch, held):
    for name, value in (("SEEDS", 100), ("LONG", 50), ("HELD", held)):
        monkeypatch.setattr(pairs, name, value)
    calls = one_file.sparkSession.sparkContext.accumulator(0)

    @pairs.broadcasting
    def counted(u, v):
        out = np.abs(u - v).sum(-1)
        calls.add(out.size)
        return out

    df, rows = one_file.withColumn("label", F.col("id") % 3), ROWS
    d = blocks.cdist("cityblock", rows, rows)
    want = {}
    for a in range(3):
        for b in range(3):
            part = d[a::3, b::3]
            i = part.min(axis=1).argmax()
            want[a, b] = (round(part[i].min(), 9), 3 * i + a, 3 * part[i].argmin() + b)
    got = {(r.label_a, r.label_b): (round(r.distance, 9), r.id_a, r.id_b) for r in pairs.directed_hausdorff(df, df, counted, by=["label"]).collect()}
    assert got == want
    assert calls.value < 600 * 600 * (2 / 3 if held > 1 << 20 else 1)  # the seeds' pairs, about a sixth, included; two tasks a row bound each for itself
    got = {(r.label_a, r.label_b): (r.id_a, r.id_b) for r in pairs.directed_hausdorff(df, df, by=["label"]).collect()}
    e = blocks.cdist("euclidean", rows, rows)
    assert got == {(a, b): (3 * i + a, 3 * e[3 * i + a, b::3].argmin() + b) for a in range(3) for b in range(3) for i in [e[a::3, b::3].min(axis=1).argmax()]}
