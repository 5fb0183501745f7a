from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinia.operators.blocks import cdist
from vicinia.plans import search
from vicinia.plans.families import NONE, Cosine, Stable, Voronoi
from vicinia.plans.tree import MEDOIDS, MedoidTree, medoid_count
from vicinia.sources.buckets import BucketStore
from vicinia.sources.vectors import wrap
from vicinia.streaming.ingest import index_stream

RNG = np.random.default_rng(8)
X = RNG.standard_normal((300, 12)) + 3 * RNG.standard_normal((6, 12))[RNG.integers(0, 6, 300)]


@pytest.fixture(scope="module")
def points(spark):
    return wrap(spark, X).cache()


def families(points):
    return [Voronoi.draw(points, L=3, k=2, m=8, w=3, seed=1), Voronoi.draw(points, L=2, k=2, m=8, w=4, metric="cityblock", seed=2), Cosine.draw(12, L=3, k=6, seed=3), Stable.draw(12, L=3, k=2, r=4.0, seed=4), Stable.draw(12, L=2, k=5, r=4.0, el=1, metric="lnorm", seed=5)]


def brute(family, asked, q, probe):
    """Candidates and ranks from the codes alone."""
    codes = family.codes(X)
    d = cdist(family.metric, X[asked], X, **family.parameters)
    out = {}
    for n, i in enumerate(asked):
        far = (codes[i][None] != codes).sum(axis=2).min(axis=1)
        found = set(np.flatnonzero(far == 0).tolist())
        for step in range(1, min(2, family.k - 1) + 1) if probe else ():
            if len(found) < q:
                found |= set(np.flatnonzero(far == step).tolist())
        out[i] = sorted(found, key=lambda j: (round(d[n, j], 9), j))[:q], found
    return out


@pytest.mark.parametrize("which", range(5))
def test_searches_equal_brute_force(spark, points, which):
    family = families(points)[which]
    asked = list(range(0, 300, 30))
    index = search.Index(family, points)
    queries = points.where(F.col("id").isin(asked))
    for probe in (False, True):
        want = brute(family, asked, 5, probe)
        found = index.probed(queries, 5) if probe else index.candidates(queries)
        got = {}
        for r in found.collect():
            got.setdefault(r.query_id, set()).add(r.id)
        assert got == {i: c for i, (_, c) in want.items()}
        ranked = index.query(queries, 5, probe).collect()
        for i, (near, _) in want.items():
            rows = sorted((r for r in ranked if r.query_id == i), key=lambda r: r.rank)
            assert [r.id for r in rows] == near and [r.rank for r in rows] == list(range(1, len(near) + 1)) and rows[0].id == i
            assert [r.distance for r in rows] == sorted(r.distance for r in rows)
    assert sorted(map(str, index.query_by_id(asked, 5).collect())) == sorted(map(str, index.query(queries, 5).collect()))


def test_wide_rows_are_padded(spark, points):
    family = Cosine.draw(12, L=1, k=12, seed=3)
    queries = points.where("id < 20")
    index = search.Index(family, points)
    rows = search.wide(index.query(queries, 5, probe=False), queries, 5).collect()
    counts = {r.query_id: r["count"] for r in index.candidates(queries).groupBy("query_id").count().collect()}
    assert [r.query_id for r in rows] == list(range(20)) and any(counts[i] < 5 for i in counts)
    assert all(len(r.neighbors) == 5 and r.neighbors.count(-1) == max(0, 5 - counts[r.query_id]) for r in rows)
    alone = points.where("id = 0").withColumn("id", F.lit(1000).cast("long"))
    none = search.wide(index.query(queries.where("false"), 2), alone, 2).collect()
    assert none[0].neighbors == [-1, -1]


def test_exact_and_recall(spark, points):
    queries = points.where("id % 50 = 0")
    truth = search.nearest_exact(queries, points, 4)
    d = cdist("euclidean", X[::50], X)
    for n, i in enumerate(range(0, 300, 50)):
        assert [r.id for r in sorted(truth.where(F.col("query_id") == i).collect(), key=lambda r: r.rank)] == np.argsort(d[n], kind="stable")[:4].tolist()
    assert search.recall(truth, truth).first().recall == 1
    index = search.Index(Voronoi.draw(points, L=8, k=2, m=8, w=3, seed=1), points)
    assert search.recall(index.query(queries, 4), truth).first().recall > 0.6


def test_ties_and_nan(spark):
    d = spark.createDataFrame([(1, 5, 1.0), (1, 3, 1.0), (1, 4, float("nan")), (1, 9, 2.0)], "query_id long, id long, distance double")
    assert [r.id for r in sorted(search.top(d, 4).collect(), key=lambda r: r.rank)] == [3, 5, 9, 4]


def test_validation(points):
    for bad in (lambda: Voronoi.draw(points, w=1), lambda: Voronoi.draw(points, m=3, w=4), lambda: Voronoi.draw(points, metric="nonesuch"), lambda: Cosine.draw(12, k=64), lambda: Cosine(np.ones((0, 4, 12))), lambda: Stable.law(None, None), lambda: Stable.law(None, "lnorm"), lambda: Stable.law(3, "minkowski"), lambda: Stable.law(1, "euclidean"), lambda: Stable.draw(12, r=0)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(NotImplementedError):
        Stable.law(None, "canberra")
    assert Stable.law(None, "e")[:2] == (2.0, "euclidean") and Stable.law(1, "pnorm") == (1.0, "minkowski", {"p": 1.0})
    for dim, match in ((13, "vectors of 13 dimensions are indexed, not of 12"), (11, "vectors of 11")):
        with pytest.raises(Exception, match=match):
            Cosine.draw(dim).hashed(points).collect()


def test_first_of_equal_medoids_wins():
    family = Voronoi(np.array([[0.0, 0.0], [0.0, 0.0], [9.0, 9.0]]), np.array([[[1, 0, 2]]]))
    assert family.codes(np.array([[1.0, 1.0], [8.0, 8.0]])).ravel().tolist() == [0, 2]


def test_stream_of_points(spark, points, tmp_path):
    points.repartition(3).write.parquet(f"{tmp_path}/in")
    family = Cosine.draw(12, L=2, k=5, seed=3)
    store = BucketStore(spark, "parquet", f"file://{tmp_path}/index")
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    index_stream(stream, family, store, f"file://{tmp_path}/progress", once=True).awaitTermination()
    want = {(r.table_id, r.bucket, r.id) for r in family.hashed(points).collect()}
    assert {tuple(r) for r in store.rows().collect()} == want
    with pytest.raises(ValueError, match="parquet"):
        index_stream(stream, family, BucketStore(spark), "unused")


def ranks(rows):
    """numpy and the JVM add in other orders, so last digits differ."""
    return sorted((*r[:3], round(r.distance, 9)) for r in rows)


@pytest.mark.parametrize("which", [0, 4])
def test_large_query_sets_and_stored_indexes_find_the_same(spark, points, which, tmp_path, monkeypatch):
    family = families(points)[which]
    queries = points.where("id % 20 = 0")
    want = ranks(search.Index(family, points).query(queries, 4).collect())
    plain = ranks(search.Index(family, points).query(queries, 4, probe=False).collect())
    written = search.Index.write(family, points, f"file://{tmp_path}/index")
    opened = search.Index.open(points, written.store.path)
    assert (opened.family.codes(X) == family.codes(X)).all() and opened.family.parameters == family.parameters
    assert ranks(opened.query(queries, 4).collect()) == want
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(search, "LISTED", 0)
    assert ranks(search.Index(family, points).query(queries, 4).collect()) == want
    assert ranks(opened.query(queries, 4, probe=False).collect()) == plain


def test_probing_finds_more(spark, points):
    """Long codes leave queries short; probing fills them up, a distance at a time."""
    index, queries = search.Index(Cosine.draw(12, L=2, k=14, seed=3), points), points.where("id % 10 = 0")
    own = {r.query_id: r["count"] for r in index.candidates(queries).groupBy("query_id").count().collect()}
    near, far = ({r.query_id: r["count"] for r in index.probed(queries, 20, d).groupBy("query_id").count().collect()} for d in (1, 2))
    assert min(own.values()) < 20 and sum(own.values()) < sum(near.values()) < sum(far.values())
    assert all(near[k] == n for k, n in own.items() if n >= 20) and all(far[k] == n for k, n in near.items() if n >= 20)


def plain_probes(family, x, probes):
    """(table, codes) of least cost, over all combinations."""
    values, costs = family.alternatives(X[x : x + 1])
    out = set()
    for t in range(family.L):
        every = [(sum(costs[0, t, j, c] for j, c in enumerate(pick)), tuple(int(values[0, t, j, c]) for j, c in enumerate(pick))) for pick in product(range(values.shape[3]), repeat=family.k)]
        out |= {(t, codes) for _, codes in sorted(every)[:probes]}
    return out


@pytest.mark.parametrize("which", range(5))
def test_probes_are_the_keys_of_least_cost(points, which):
    family = families(points)[which]
    tables, codes = family.probed_entries(X[:6], 7)
    for x in range(6):
        assert {(int(t), tuple(c.tolist())) for t, c in zip(tables, codes[x], strict=True)} == plain_probes(family, x, 7)
        assert {(t, tuple(c)) for t, c in enumerate(family.codes(X[x : x + 1])[0].astype(int).tolist())} <= plain_probes(family, x, 7)


@pytest.mark.parametrize("which", range(6))
def test_probed_searches_equal_plain_ones(spark, points, which, tmp_path, monkeypatch):
    family = [*families(points), MedoidTree.draw(points, spill=4, probes=5)][which]
    queries, probes = points.where("id % 25 = 0"), 5
    tables, codes = family.entries(X)
    own = [{(int(t), tuple(c)) for t, c in zip(tables, row, strict=True)} for row in codes.astype(int).tolist()]
    tables, codes = family.probed_entries(X, probes)
    d = cdist(family.metric, X, X, **family.parameters)
    want, met = {}, {}
    for i in range(0, 300, 25):
        asked = {(int(t), tuple(c)) for t, c in zip(tables, codes[i].astype(int).tolist(), strict=True)} - {(0, (NONE,))}
        met[i] = {j for j in range(300) if len(asked & own[j]) >= family.votes}
        want[i] = sorted(met[i], key=lambda j: (round(d[i, j], 9), j))[:4]
    index = search.Index(family, points)
    written = search.Index.write(family, points, f"file://{tmp_path}/index")

    def check(index):
        got, near = {}, {}
        for r in index.candidates(queries, probes).collect():
            assert r.id not in got.setdefault(r.query_id, set())
            got[r.query_id].add(r.id)
        assert got == met
        for r in index.query(queries, 4, probe=False, probes=probes).orderBy("query_id", "rank").collect():
            near.setdefault(r.query_id, []).append(r.id)
            assert r["rank"] == len(near[r.query_id]) and abs(r.distance - d[r.query_id, r.id]) < 1e-9
        assert near == want

    check(index)
    check(search.Index.open(points, written.store.path))
    monkeypatch.setattr(search, "PAIRS", 40)
    check(search.Index(family, points))
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    check(search.Index(family, points))
    assert index.query(queries.where("false"), 4, probes=probes).count() == 0


def test_a_tree_grows_with_its_table(points):
    assert [medoid_count(n) for n in (10, 500, 2000, 10**6, 10**12)] == [2, 25, 89, 2000, MEDOIDS]
    tree = MedoidTree.draw(points)
    assert len(tree.medoids) == 15 and tree.coarse == 4 and tree.opened == 3
    lists = tree._lists(X, 15)
    for x, row in zip(X[:40], lists[:40], strict=True):
        far = ((tree.medoids - x) ** 2).sum(axis=1)
        cells = np.argsort(far[:4], kind="stable")[:3]
        under = {m for m in range(15) if set(np.argsort(((tree.medoids[:4] - tree.medoids[m]) ** 2).sum(axis=1), kind="stable")[:2].tolist()) & set(cells.tolist())}
        assert [m for m in row.tolist() if m != NONE] == sorted(under, key=lambda m: far[m])
    same = MedoidTree(np.repeat(X[:3], 2, axis=0), coarse=2, opened=2)
    assert all(a % 2 == 0 and b == a + 1 for a, b in same._lists(X[:50], 2).tolist())
    for bad in ({"coarse": 0}, {"coarse": 7}, {"coarse": 2, "votes": 0}):
        with pytest.raises(ValueError):
            MedoidTree(X[:6], **bad)


def test_neighbouring_codes_are_met_without_broadcasts(spark, points):
    """Of the pairs that neighbouring codes give only the q best a task leave it, and nothing goes through the driver."""
    index, queries = search.Index(Stable.draw(12, L=3, k=5, r=4.0, seed=4), points), points.where("id % 10 = 0")
    near = index.query(queries, 5)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" in plan and "Broadcast" not in plan
    sent = index._probed(queries, 5, 2, 5)
    assert sent.groupBy("query_id", F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 5
    assert near.count() < index.probed(queries, 5).count()


def test_code_distances():
    a, b = RNG.integers(0, 3, (7, 4, 5)), RNG.integers(0, 3, (9, 4, 5))
    want = (a[:, None] != b[None]).sum(axis=3).min(axis=2)
    np.testing.assert_array_equal(search._code_distances(a.transpose(1, 2, 0), b.transpose(1, 2, 0)), want)


@pytest.mark.parametrize("few", [True, False])
def test_stored_searches_send_the_best_of_each_task_only(spark, points, few, tmp_path, monkeypatch):
    if not few:
        monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    family, queries = MedoidTree.draw(points, spill=4, probes=5), points.where("id % 25 = 0")
    index = search.Index.write(family, points, f"file://{tmp_path}/index")
    sent = index._meeting(queries, 5, 2)
    assert sent.groupBy("query_id", F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 2
    want = ranks(search.Index(family, points).query(queries, 2, probe=False, probes=5).collect())
    assert ranks(index.query(queries, 2, probe=False, probes=5).collect()) == want and len(want) > 12
