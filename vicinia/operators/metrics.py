"""Distances between two array columns as Catalyst expressions.

``distance("euclidean", u, v)`` returns a Column. With ``dim`` the sums are unrolled into
plain arithmetic, which whole-stage code generation compiles; without it they are
higher-order functions, which take arrays of any length. Names are looked up without
regard to case. An undefined ratio (0/0) is NaN, which Spark sorts last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN = float("nan")


@dataclass(frozen=True)
class Vectors:
    """Two array columns and how to sum over their elements."""

    u: Column
    v: Column
    dim: int | None = None

    def total(self, f: Callable[[Column, Column], Column]) -> Column:
        if self.dim:
            return _balanced([f(self.u[i], self.v[i]) for i in range(self.dim)], lambda a, b: a + b)
        return F.aggregate(F.zip_with(self.u, self.v, f), F.lit(0.0), lambda a, x: a + x)

    def weighted(self, weights: list[float], f: Callable[[Column, Column, Column], Column]) -> Column:
        """The sum of f(u, v, w) with a constant weight for each place."""
        if self.dim:
            return _balanced([f(self.u[i], self.v[i], F.lit(float(w))) for i, w in enumerate(weights)], lambda a, b: a + b)
        pair = F.zip_with(self.u, self.v, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        each = F.zip_with(pair, F.array(*[F.lit(float(w)) for w in weights]), lambda p, w: f(p["a"], p["b"], w))
        return F.aggregate(each, F.lit(0.0), lambda a, x: a + x)

    def largest(self, f: Callable[[Column, Column], Column]) -> Column:
        if self.dim:
            each = [f(self.u[i], self.v[i]) for i in range(self.dim)]
            return F.greatest(*each) if len(each) > 1 else each[0]
        return F.array_max(F.zip_with(self.u, self.v, f))

    @property
    def size(self) -> Column:
        return F.lit(float(self.dim)) if self.dim else F.size(self.u).cast("double")

    def counts(self) -> tuple[Column, Column, Column, Column]:
        """How many places are true in both, in u only, in v only, in neither (elements are truth values)."""
        one = lambda c: F.when(c, 1.0).otherwise(0.0)
        return (
            self.total(lambda a, b: one(a & b)),
            self.total(lambda a, b: one(a & ~b)),
            self.total(lambda a, b: one(~a & b)),
            self.total(lambda a, b: one(~a & ~b)),
        )


def _balanced(parts: list[Column], join: Callable[[Column, Column], Column]) -> Column:
    """A tree rather than a chain, so that wide vectors don't nest deeply."""
    while len(parts) > 1:
        parts = [join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def ratio(over: Column, under: Column) -> Column:
    return F.when(under != 0, over / under).otherwise(F.lit(NAN))


def euclidean(x: Vectors) -> Column:
    return F.sqrt(sqeuclidean(x))


def sqeuclidean(x: Vectors) -> Column:
    return x.total(lambda a, b: (a - b) * (a - b))


def cityblock(x: Vectors) -> Column:
    return x.total(lambda a, b: F.abs(a - b))


def chebyshev(x: Vectors) -> Column:
    return x.largest(lambda a, b: F.abs(a - b))


def minkowski(x: Vectors, p: float = 2) -> Column:
    if p < 1:
        raise ValueError("p must be at least 1")
    return F.pow(x.total(lambda a, b: F.pow(F.abs(a - b), F.lit(float(p)))), F.lit(1 / p))


def wminkowski(x: Vectors, w: list[float], p: float = 2) -> Column:
    if p < 1:
        raise ValueError("p must be at least 1")
    return F.pow(x.weighted(w, lambda a, b, k: F.pow(k * F.abs(a - b), F.lit(float(p)))), F.lit(1 / p))


def seuclidean(x: Vectors, V: list[float]) -> Column:
    return F.sqrt(x.weighted(V, lambda a, b, k: ratio((a - b) * (a - b), k)))


def mahalanobis(x: Vectors, VI: list[list[float]]) -> Column:
    """sqrt(d VI d'): the form is diagonalised on the driver, so a row costs one pass for each axis."""
    form = np.asarray(VI, dtype=float)
    values, axes = np.linalg.eigh((form + form.T) / 2)
    squares = []
    for value, axis in zip(values.tolist(), axes.T.tolist(), strict=True):
        along = x.weighted(axis, lambda a, b, k: k * (a - b))
        squares.append(F.lit(value) * along * along)
    return F.sqrt(F.greatest(_balanced(squares, lambda a, b: a + b), F.lit(0.0)))


def cosine(x: Vectors) -> Column:
    norm = F.sqrt(x.total(lambda a, _: a * a)) * F.sqrt(x.total(lambda _, b: b * b))
    return F.lit(1.0) - ratio(x.total(lambda a, b: a * b), norm)


def correlation(x: Vectors) -> Column:
    """The sums are of differences from the first element, so a common offset doesn't cancel them away."""
    n, u0, v0 = x.size, x.u[0], x.v[0]
    su, sv = x.total(lambda a, _: a - u0), x.total(lambda _, b: b - v0)
    cross = x.total(lambda a, b: (a - u0) * (b - v0)) - su * sv / n
    uu = x.total(lambda a, _: (a - u0) * (a - u0)) - su * su / n
    vv = x.total(lambda _, b: (b - v0) * (b - v0)) - sv * sv / n
    return F.lit(1.0) - ratio(cross, F.sqrt(F.greatest(uu, F.lit(0.0))) * F.sqrt(F.greatest(vv, F.lit(0.0))))


def canberra(x: Vectors) -> Column:
    def part(a: Column, b: Column) -> Column:
        under = F.abs(a) + F.abs(b)
        return F.when(under > 0, F.abs(a - b) / under).otherwise(0.0)

    return x.total(part)


def braycurtis(x: Vectors) -> Column:
    return ratio(x.total(lambda a, b: F.abs(a - b)), x.total(lambda a, b: F.abs(a + b)))


def hamming(x: Vectors) -> Column:
    return ratio(x.total(lambda a, b: F.when(a != b, 1.0).otherwise(0.0)), x.size)


def jaccard(x: Vectors) -> Column:
    """Of numbers: places that differ among those where either is not zero; of truth values likewise."""
    either = lambda a, b: (a.cast("double") != 0) | (b.cast("double") != 0)
    return ratio(x.total(lambda a, b: F.when((a != b) & either(a, b), 1.0).otherwise(0.0)), x.total(lambda a, b: F.when(either(a, b), 1.0).otherwise(0.0)))


def dice(x: Vectors) -> Column:
    tt, tf, ft, _ = x.counts()
    return ratio(tf + ft, 2 * tt + tf + ft)


def kulsinski(x: Vectors) -> Column:
    tt, tf, ft, _ = x.counts()
    return ratio(tf + ft - tt + x.size, tf + ft + x.size)


def rogerstanimoto(x: Vectors) -> Column:
    tt, tf, ft, ff = x.counts()
    return ratio(2 * (tf + ft), tt + ff + 2 * (tf + ft))


def russellrao(x: Vectors) -> Column:
    return ratio(x.size - x.total(lambda a, b: F.when(a & b, 1.0).otherwise(0.0)), x.size)


def sokalsneath(x: Vectors) -> Column:
    tt, tf, ft, _ = x.counts()
    return ratio(2 * (tf + ft), tt + 2 * (tf + ft))


def yule(x: Vectors) -> Column:
    tt, tf, ft, ff = x.counts()
    return ratio(2 * tf * ft, tt * ff + tf * ft)


def log_part(x: Column) -> Column:
    """The logarithm of a part of a composition; of 0 it is -Infinity, and negative parts fail."""
    negative = F.raise_error(F.lit("a composition has no negative parts")).cast("double")
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, negative).otherwise(F.lit(NAN))


def aitchison(x: Vectors) -> Column:
    """The distance of centred log-ratios. Centring takes the logarithm of the whole out, so parts needn't sum to 1 first.

    The sums are of differences from the first log-ratio, so a common factor doesn't cancel them away.
    """
    first = log_part(x.u[0]) - log_part(x.v[0])
    ratio_of = lambda a, b: log_part(a) - log_part(b) - first
    whole = x.total(ratio_of)
    squares = x.total(lambda a, b: ratio_of(a, b) * ratio_of(a, b))
    return F.sqrt(F.greatest(squares - whole * whole / x.size, F.lit(0.0)))


#: Which elements a metric takes.
NUMBERS, TRUTHS, EITHER = "numbers", "truths", "either"

_metrics: dict[str, tuple[Callable[..., Column], str, tuple[str, ...]]] = {
    "euclidean": (euclidean, NUMBERS, ("euclid", "eu", "e")),
    "sqeuclidean": (sqeuclidean, NUMBERS, ("sqe", "sqeuclid")),
    "cityblock": (cityblock, NUMBERS, ("cblock", "cb", "c")),
    "chebyshev": (chebyshev, NUMBERS, ("chebychev", "cheby", "cheb", "ch")),
    "minkowski": (minkowski, NUMBERS, ("mi", "m", "pnorm")),
    "wminkowski": (wminkowski, NUMBERS, ("wmi", "wm", "wpnorm")),
    "seuclidean": (seuclidean, NUMBERS, ("se", "s")),
    "mahalanobis": (mahalanobis, NUMBERS, ("mahal", "mah")),
    "cosine": (cosine, NUMBERS, ("cos",)),
    "correlation": (correlation, NUMBERS, ("co",)),
    "canberra": (canberra, NUMBERS, ()),
    "braycurtis": (braycurtis, NUMBERS, ()),
    "hamming": (hamming, EITHER, ("hamm", "ha", "h", "matching")),
    "jaccard": (jaccard, EITHER, ("jacc", "ja", "j")),
    "dice": (dice, TRUTHS, ()),
    "kulsinski": (kulsinski, TRUTHS, ()),
    "rogerstanimoto": (rogerstanimoto, TRUTHS, ()),
    "russellrao": (russellrao, TRUTHS, ()),
    "sokalmichener": (rogerstanimoto, TRUTHS, ()),
    "sokalsneath": (sokalsneath, TRUTHS, ()),
    "yule": (yule, TRUTHS, ()),
    "aitchison": (aitchison, NUMBERS, ("simplex", "clr")),
}
_names = {alias: name for name, (_, _, aliases) in _metrics.items() for alias in (name, *aliases)}


def resolve(name: str) -> str:
    """The canonical name of a metric, by name or alias."""
    if (found := _names.get(name.lower())) is None:
        raise ValueError(f"unknown metric {name!r}; known are {', '.join(sorted(_metrics))}")
    return found


def known() -> list[str]:
    return list(_metrics)


def takes(name: str) -> str:
    return _metrics[resolve(name)][1]


def elements(column: Column | str, kind: str) -> Column:
    """An array column cast for a metric; a number is true if it isn't zero."""
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("array<double>") if kind != TRUTHS else F.transform(column.cast("array<double>"), lambda x: x != 0)


def check(name: str, p: float = 2, **_) -> None:
    """Refuse an unknown name and an exponent under 1."""
    if resolve(name) in ("minkowski", "wminkowski") and p < 1:
        raise ValueError("p must be at least 1")


def distance(name: str, u: Column | str, v: Column | str, dim: int | None = None, **parameters) -> Column:
    """The distance between two array columns. Parameters: p, w, V or VI as the metric asks."""
    metric, kind, _ = _metrics[resolve(name)]
    return metric(Vectors(elements(u, kind), elements(v, kind), dim), **parameters)


def fit(name: str, data: DataFrame, vec_col: str = "vec") -> dict:
    """Parameters that a metric learns from the data: V of seuclidean and VI of mahalanobis; one aggregation, d or d*d numbers to the driver."""
    name = resolve(name)
    if name not in ("seuclidean", "mahalanobis"):
        return {}
    vec = F.col(vec_col).cast("array<double>")
    d = data.select(F.max(F.size(vec))).first()[0] or 0
    if name == "seuclidean":
        row = data.agg(*[F.var_samp(vec[i]).alias(f"v{i}") for i in range(d)]).first()
        return {"V": [float(x) for x in row]}
    if not d:
        raise ValueError("0 rows are too few for a covariance")
    base = data.where(vec.isNotNull()).select(vec.alias("v")).first()[0]  # near the data: sums of differences from it don't cancel

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, np.zeros(d), np.zeros((d, d))
        for b in batches:
            x = b.column(0).drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, d) - base
            n, total, squares = n + len(x), total + x.sum(axis=0), squares + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()]), pa.array([squares.ravel().tolist()])], ["n", "total", "squares"])

    # a row for each partition, d * d numbers each, summed over partitions by Spark
    parts = data.select(vec.alias("v")).mapInArrow(sums, "n long, total array<double>, squares array<double>")
    flat = parts.select("n", F.posexplode(F.concat("total", "squares")).alias("at", "x"))
    rows = flat.groupBy("at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).toArrow().sort_by("at")
    n, x = rows["n"][0].as_py(), rows["x"].to_numpy()
    if n <= d:
        raise ValueError(f"{n} rows are too few for a covariance of {d} dimensions")
    cov = (x[d:].reshape(d, d) - np.outer(x[:d], x[:d]) / n) / (n - 1)
    return {"VI": np.linalg.inv(cov).T.tolist()}


def stacked(frames: list[DataFrame], vec_col: str = "vec") -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [f.select(vec_col) for f in frames])
