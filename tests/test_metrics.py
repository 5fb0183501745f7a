import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinia.operators import blocks, metrics, pairs
from vicinia.sources.vectors import wrap

RNG = np.random.default_rng(5)
A, B = RNG.random((6, 10)), RNG.random((7, 10))
PARAMETERS = {"minkowski": {"p": 1.23}, "wminkowski": {"p": 1.23, "w": (1 / np.vstack([A, B]).std(axis=0)).tolist()}, "seuclidean": {"V": np.vstack([A, B]).var(axis=0, ddof=1).tolist()}, "mahalanobis": {"VI": np.linalg.inv(np.cov(np.vstack([A, B]).T)).T.tolist()}}


def scalar(name, u, v, p=2, w=None, V=None, VI=None):
    """Each definition spelled out for two vectors."""
    d = [abs(a - b) for a, b in zip(u, v, strict=True)]
    n = len(u)
    if name in ("euclidean", "sqeuclidean"):
        s = sum(x * x for x in d)
        return math.sqrt(s) if name == "euclidean" else s
    if name == "cityblock":
        return sum(d)
    if name == "chebyshev":
        return max(d)
    if name == "minkowski":
        return sum(x**p for x in d) ** (1 / p)
    if name == "wminkowski":
        return sum((k * x) ** p for k, x in zip(w, d, strict=True)) ** (1 / p)
    if name == "seuclidean":
        return math.sqrt(sum(x * x / k for x, k in zip(d, V, strict=True)))
    if name == "mahalanobis":
        e = np.array(u) - np.array(v)
        return math.sqrt(e @ np.array(VI) @ e)
    if name in ("cosine", "correlation"):
        mu, mv = (sum(u) / n, sum(v) / n) if name == "correlation" else (0, 0)
        u, v = [x - mu for x in u], [x - mv for x in v]
        under = math.sqrt(sum(x * x for x in u) * sum(x * x for x in v))
        return 1 - sum(a * b for a, b in zip(u, v, strict=True)) / under if under else math.nan
    if name == "canberra":
        return sum(x / (abs(a) + abs(b)) for x, a, b in zip(d, u, v, strict=True) if a or b)
    if name == "braycurtis":
        under = sum(abs(a + b) for a, b in zip(u, v, strict=True))
        return sum(d) / under if under else math.nan
    if name == "aitchison":
        logs = [[math.log(x / sum(y)) for x in y] for y in (u, v)]
        centred = [[x - sum(y) / n for x in y] for y in logs]
        return math.dist(*centred)
    tt = sum(bool(a) and bool(b) for a, b in zip(u, v, strict=True))
    tf = sum(bool(a) and not b for a, b in zip(u, v, strict=True))
    ft = sum(bool(b) and not a for a, b in zip(u, v, strict=True))
    ff = n - tt - tf - ft
    over, under = {
        "hamming": (sum(a != b for a, b in zip(u, v, strict=True)), n),
        "jaccard": (sum(a != b and bool(a or b) for a, b in zip(u, v, strict=True)), n - ff),
        "dice": (tf + ft, 2 * tt + tf + ft),
        "kulsinski": (tf + ft - tt + n, tf + ft + n),
        "rogerstanimoto": (2 * (tf + ft), tt + ff + 2 * (tf + ft)),
        "russellrao": (n - tt, n),
        "sokalmichener": (2 * (tf + ft), tt + ff + 2 * (tf + ft)),
        "sokalsneath": (2 * (tf + ft), tt + 2 * (tf + ft)),
        "yule": (2 * tf * ft, tt * ff + tf * ft),
    }[name]
    return over / under if under else math.nan


def frame(spark, rows):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id long, vec array<double>")


@pytest.mark.parametrize("name", metrics.known())
def test_columns_and_blocks_follow_the_definition(spark, name):
    a, b = (A, B) if metrics.takes(name) == metrics.NUMBERS else ((A > 0.5) * 1.0, (B > 0.5) * 1.0)
    parameters = PARAMETERS.get(name, {})
    want = np.array([[scalar(name, u, v, **parameters) for v in b.tolist()] for u in a.tolist()])
    np.testing.assert_allclose(blocks.cdist(name, a, b, **parameters), want, rtol=1e-9, atol=1e-9)
    for dim in (None, 10):
        got = np.zeros_like(want)
        for r in pairs.pairwise(frame(spark, a), frame(spark, b), name.upper(), dim=dim, **parameters).collect():
            got[r.id_a, r.id_b] = r.distance
        np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)


def test_undefined_ratios_are_nan_and_last(spark):
    zero, one = [0.0, 0.0], [1.0, 1.0]
    df = spark.createDataFrame([(zero, zero, one)], "z array<double>, y array<double>, o array<double>")
    for name in ("cosine", "braycurtis", "jaccard", "dice", "sokalsneath", "yule", "aitchison"):
        assert math.isnan(df.select(metrics.distance(name, "z", "y")).first()[0]), name
    assert df.select(metrics.distance("canberra", "z", "y")).first()[0] == 0
    assert math.isnan(df.select(metrics.distance("correlation", "o", "o")).first()[0])
    assert [r[0] for r in spark.createDataFrame([(float("nan"),), (2.0,)], "d double").orderBy("d").collect()][0] == 2.0


def test_names(spark):
    assert metrics.resolve("ChebyChev") == "chebyshev" and metrics.resolve("wpnorm") == "wminkowski" and metrics.resolve("matching") == "hamming"
    with pytest.raises(ValueError, match="unknown metric"):
        metrics.resolve("nonesuch")
    with pytest.raises(ValueError, match="at least 1"):
        metrics.distance("minkowski", "a", "b", p=0.5)
    with pytest.raises(ValueError, match="columns"):
        blocks.cdist("euclidean", A, B[:, :3])


def test_worked_examples(spark):
    places = np.array([[35.0456, -85.2672], [35.1174, -89.9711], [35.9728, -83.9422], [36.1667, -86.7833]])
    got = {(r.id_a, r.id_b): round(r.distance, 4) for r in pairs.condensed(frame(spark, places), "euclidean").collect()}
    assert got == {(0, 1): 4.7044, (0, 2): 1.6172, (0, 3): 1.8856, (1, 2): 6.0893, (1, 3): 3.3561, (2, 3): 2.8477}
    cube = np.array([[i >> 2 & 1, i >> 1 & 1, i & 1] for i in range(8)], float)
    got = {r.id_b: round(r.distance, 6) for r in pairs.pairwise(frame(spark, np.array([[0.1, 0.2, 0.4]])), frame(spark, cube), "cityblock").collect()}
    assert got == {0: 0.7, 1: 0.9, 2: 1.3, 3: 1.5, 4: 1.5, 5: 1.7, 6: 2.1, 7: 2.3}


def test_hausdorff_against_brute_force(spark):
    (r,) = pairs.directed_hausdorff(frame(spark, A), frame(spark, B)).collect()
    d = blocks.cdist("euclidean", A, B)
    assert abs(r.distance - d.min(axis=1).max()) < 1e-12 and r.id_a == d.min(axis=1).argmax() and r.id_b == d[r.id_a].argmin()


def test_fitted_parameters(spark):
    df = frame(spark, RNG.random((40, 4)))
    data = np.array([r.vec for r in df.collect()])
    np.testing.assert_allclose(metrics.fit("se", df)["V"], data.var(axis=0, ddof=1))
    np.testing.assert_allclose(metrics.fit("mahal", df)["VI"], np.linalg.inv(np.cov(data.T)).T)
    with pytest.raises(ValueError, match="too few"):
        metrics.fit("mahalanobis", df.limit(3))
    got = pairs.pairwise(df, df, "seuclidean").where("id_a = 1 and id_b = 2").first().distance
    V = np.vstack([data, data]).var(axis=0, ddof=1)
    assert abs(got - np.sqrt(((data[1] - data[2]) ** 2 / V).sum())) < 1e-9


def test_listed_square_and_callable(spark):
    a = frame(spark, A)
    d = blocks.cdist("cityblock", A, A)
    full = {(r.id_a, r.id_b): r.distance for r in pairs.square(pairs.condensed(a, "c"), a).collect()}
    assert len(full) == 36 and all(abs(full[i, j] - d[i, j]) < 1e-9 for i, j in full)
    some = spark.createDataFrame([(0, 3), (5, 5), (2, 99)], "id_a long, id_b long")
    assert {(r.id_a, r.id_b): round(r.distance, 9) for r in pairs.listed(some, a, a, "cityblock").collect()} == {(0, 3): round(d[0, 3], 9), (5, 5): 0.0}
    own = pairs.listed(some, a, a, lambda u, v: float(np.abs(u - v).sum()) + 1).where("id_a = 0").first().distance
    assert abs(own - d[0, 3] - 1) < 1e-9
    with pytest.raises(ValueError, match="callable"):
        pairs.metric_column(3, F.col("a"), F.col("b"))


def test_compositions_have_no_negative_parts(spark):
    df = spark.createDataFrame([([1.0, -1.0], [1.0, 2.0])], "u array<double>, v array<double>")
    with pytest.raises(Exception, match="negative parts"):
        df.select(metrics.distance("aitchison", "u", "v")).collect()
    with pytest.raises(ValueError, match="negative parts"):
        blocks.cdist("aitchison", [[1.0, -1.0]], [[1.0, 2.0]])


@pytest.mark.parametrize("dim", [None, 12])
def test_a_common_offset_doesnt_cancel(spark, dim):
    rng = np.random.default_rng(4)
    u, v = 1e8 + rng.standard_normal((2, 12))
    got = spark.createDataFrame([(u.tolist(), v.tolist())], "u array<double>, v array<double>").select(metrics.distance("correlation", "u", "v", dim).alias("d")).first().d
    assert abs(got - (1 - np.corrcoef(u, v)[0, 1])) < 1e-6
    a, b = np.exp(rng.standard_normal((2, 12))) * np.array([[1e100], [1e-100]])
    got = spark.createDataFrame([(a.tolist(), b.tolist())], "u array<double>, v array<double>").select(metrics.distance("aitchison", "u", "v", dim).alias("d")).first().d
    la, lb = np.log(a), np.log(b)
    assert abs(got - np.linalg.norm(la - la.mean() - lb + lb.mean())) < 1e-9


def test_covariance_of_many_dimensions(spark):
    x = 1e6 + np.random.default_rng(5).standard_normal((200, 20))
    VI = metrics.fit("mahalanobis", wrap(spark, x).repartition(5))["VI"]
    assert np.allclose(VI, np.linalg.inv(np.cov(x.T)), rtol=1e-5, atol=1e-6)
