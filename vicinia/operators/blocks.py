"""The same distances between blocks of rows in numpy, for hashing inside Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from vicinia.operators import metrics

#: Differences (or counts) of a block of rows that are held at once, few enough to stay in a core's cache.
CELLS = 1 << 17


def _truths(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    a, b = (a != 0).astype(float), (b != 0).astype(float)
    tt = a @ b.T
    ta, tb = a.sum(axis=1)[:, None], b.sum(axis=1)[None]
    return tt, ta - tt, tb - tt, a.shape[1] - ta - tb + tt


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Not by a matrix product, whose last bits depend on the place in its block: copies shall tie."""
    return 1 - each_pair(lambda u, v: (u * v).sum(-1))(a, b) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None])


def _centred(a: np.ndarray) -> np.ndarray:
    """From the first element on, so that equal elements come to 0."""
    a = a - a[:, :1]
    return a - a.mean(axis=1, keepdims=True)


def _mahalanobis(a: np.ndarray, b: np.ndarray, form: np.ndarray) -> np.ndarray:
    """The form is diagonalised, so a pair costs a square for each axis."""
    values, axes = np.linalg.eigh((form + form.T) / 2)
    squares = each_pair(lambda u, v: ((u - v) ** 2 * values).sum(-1))(a @ axes, b @ axes)
    return np.sqrt(np.maximum(squares, 0))


def _clr(a: np.ndarray) -> np.ndarray:
    if (a < 0).any():
        raise ValueError("a composition has no negative parts")
    logs = np.log(a / a.sum(axis=1, keepdims=True))
    return logs - logs.mean(axis=1, keepdims=True)


def each_pair(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[..., np.ndarray]:
    """A metric of differences, as many rows of a at a time as keep to CELLS differences, one at least."""

    def run(a: np.ndarray, b: np.ndarray, **parameters) -> np.ndarray:
        step = max(1, CELLS // max(1, b.size))
        parts = [f(a[i : i + step, None, :], b[None], **parameters) for i in range(0, len(a), step)]
        return np.concatenate(parts) if parts else np.zeros((0, len(b)))

    return run


def _counted(ratio: Callable[..., tuple[np.ndarray, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A ratio of counts, as many rows of a at a time as keep about eight numbers a pair to CELLS, one at least."""
    out = np.empty((len(a), len(b)))
    step = max(1, CELLS // max(1, 8 * len(b)))
    for i in range(0, len(a), step):
        np.divide(*ratio(*_truths(a[i : i + step], b)), out=out[i : i + step])
    return out


def _of_truths(f: Callable[..., np.ndarray], ratio: Callable[..., tuple]) -> Callable[..., np.ndarray]:
    """f or, where all elements are 0 and 1, the ratio of counts that it comes to."""

    def run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _counted(ratio, a, b) if all(((x == 0) | (x == 1)).all() for x in (a, b)) else f(a, b)

    return run


def _canberra(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """0 where both are 0: the least number takes a zero's place below."""
    over, under = np.abs(u - v), np.abs(u) + np.abs(v)
    over /= np.maximum(under, np.nextafter(0, 1), out=under)
    return over.sum(-1)


#: What a metric of truth values divides and by what, from how many places are true in both, in the first only, in the second only, in neither.
_ratios: dict[str, Callable[..., tuple[np.ndarray, np.ndarray]]] = {
    "dice": lambda tt, tf, ft, ff: (tf + ft, 2 * tt + tf + ft),
    "kulsinski": lambda tt, tf, ft, ff: (2 * (tf + ft) + ff, tt + 2 * (tf + ft) + ff),
    "rogerstanimoto": lambda tt, tf, ft, ff: (2 * (tf + ft), tt + ff + 2 * (tf + ft)),
    "russellrao": lambda tt, tf, ft, ff: (tf + ft + ff, tt + tf + ft + ff),
    "sokalmichener": lambda tt, tf, ft, ff: (2 * (tf + ft), tt + ff + 2 * (tf + ft)),
    "sokalsneath": lambda tt, tf, ft, ff: (2 * (tf + ft), tt + 2 * (tf + ft)),
    "yule": lambda tt, tf, ft, ff: (2 * tf * ft, tt * ff + tf * ft),
}


_numbers: dict[str, Callable[..., np.ndarray]] = {
    "euclidean": each_pair(lambda u, v: np.sqrt(((u - v) ** 2).sum(-1))),
    "sqeuclidean": each_pair(lambda u, v: ((u - v) ** 2).sum(-1)),
    "cityblock": each_pair(lambda u, v: np.abs(u - v).sum(-1)),
    "chebyshev": each_pair(lambda u, v: np.abs(u - v).max(-1)),
    "minkowski": each_pair(lambda u, v, p=2: (np.abs(u - v) ** p).sum(-1) ** (1 / p)),
    "wminkowski": each_pair(lambda u, v, w, p=2: ((np.asarray(w) * np.abs(u - v)) ** p).sum(-1) ** (1 / p)),
    "seuclidean": each_pair(lambda u, v, V: np.sqrt(((u - v) ** 2 / np.asarray(V)).sum(-1))),
    "mahalanobis": lambda a, b, VI: _mahalanobis(a, b, np.asarray(VI, dtype=float)),
    "cosine": lambda a, b: _cosine(a, b),
    "correlation": lambda a, b: _cosine(_centred(a), _centred(b)),
    "canberra": each_pair(_canberra),
    "braycurtis": each_pair(lambda u, v: np.abs(u - v).sum(-1) / np.abs(u + v).sum(-1)),
    "hamming": _of_truths(each_pair(lambda u, v: (u != v).mean(-1)), lambda tt, tf, ft, ff: (tf + ft, tt + tf + ft + ff)),
    "jaccard": _of_truths(each_pair(lambda u, v: ((u != v) & ((u != 0) | (v != 0))).sum(-1) / ((u != 0) | (v != 0)).sum(-1)), lambda tt, tf, ft, ff: (tf + ft, tt + tf + ft)),
    "aitchison": lambda a, b: _numbers["euclidean"](_clr(a), _clr(b)),
}


def cdist(name: str, a: np.ndarray, b: np.ndarray, **parameters) -> np.ndarray:
    """Distances of each row of a to each of b; undefined ones are NaN."""
    a, b = np.atleast_2d(np.asarray(a, dtype=float)), np.atleast_2d(np.asarray(b, dtype=float))
    if a.shape[1] != b.shape[1]:
        raise ValueError(f"rows of {a.shape[1]} and of {b.shape[1]} columns")
    name = metrics.resolve(name)
    with np.errstate(divide="ignore", invalid="ignore"):
        return _counted(_ratios[name], a, b) if metrics.takes(name) == metrics.TRUTHS else _numbers[name](a, b, **parameters)
