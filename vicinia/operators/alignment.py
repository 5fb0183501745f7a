"""String distances from global alignment with affine gaps.

The distance is the larger self-score less the alignment score; a gap of length g costs
``gap_open + (g - 1) * gap_extend``. With scores 0 and -1 and unit gaps that is the edit
distance, for which Spark's own function is used. Otherwise an Arrow UDF aligns the
different pairs of a batch together, cell by cell along the anti-diagonals.

The normalised form minimises (largest self-score - score) / length over alignments by
iterating on the ratio, from that of an alignment whose cells each take the move of the
best score a column. Each round aligns with every pair of aligned symbols charged the
present ratio, and takes the ratio of the alignment found, until it stays. Gap columns
count in the length but aren't charged.

Ties: an open gap goes on rather than that a new one opens; a pair of symbols must beat
both gaps, and a gap that uses up a symbol of the first string must beat the other one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from vicinia.sources.matrices import checked, named_matrix

ROUNDS = 100
#: Cells of an anti-diagonal over all pairs that are aligned together.
CELLS = 1 << 20


@dataclass(frozen=True)
class Scoring:
    """Scores of symbol pairs (None: 0 if equal, else -1) and gap costs."""

    matrix: dict[str, float] | None = None
    gap_open: float = 1.0
    gap_extend: float = 1.0

    def pair(self, a: str, b: str) -> float:
        if self.matrix is None:
            return 0.0 if a == b else -1.0
        if (s := self.matrix.get(a + b)) is None and (s := self.matrix.get(b + a)) is None:
            raise KeyError(a + b)
        return s

    def itself(self, s: str) -> float:
        return sum(self.pair(c, c) for c in s)

    def table(self, symbols: str) -> np.ndarray:
        """Scores of all pairs of the symbols; NaN where the matrix has none."""

        def known(a: str, b: str) -> float:
            try:
                return self.pair(a, b)
            except KeyError:
                return np.nan

        return np.array([[known(a, b) for b in symbols] for a in symbols])


Cells = tuple[np.ndarray, np.ndarray, np.ndarray]  # objective, score, length


class Together:
    """Alignments of several pairs of strings at once.

    A diagonal holds for every pair the cells (i, d - i) after i symbols of the first
    string; cells beyond a pair's own strings are computed too and never read.
    """

    def __init__(self, pairs: list[tuple[str, str]], by: Scoring):
        symbols = "".join(sorted({c for p in pairs for s in p for c in s}))
        number = {c: k for k, c in enumerate(symbols)}
        self.by, self.sizes = by, np.array([[len(u), len(v)] for u, v in pairs])
        table = by.table(symbols) if symbols else np.zeros((1, 1))
        u, v = (np.array([[number[c] for c in p[k]] + [0] * (self.sizes[:, k].max() - len(p[k])) for p in pairs], dtype=np.int64).reshape(len(pairs), -1) for k in (0, 1))
        self.scores = table[u[:, :, None], v[:, None, :]]
        inside = (np.arange(u.shape[1]) < self.sizes[:, :1])[:, :, None] & (np.arange(v.shape[1]) < self.sizes[:, 1:])[:, None, :]
        if (lost := inside & np.isnan(self.scores)).any():
            n, i, j = np.argwhere(lost)[0]
            raise KeyError(pairs[n][0][i] + pairs[n][1][j])
        self.most = np.array([max(by.itself(a), by.itself(b)) for a, b in pairs])

    def best(self, charge: np.ndarray | float = 0.0, greedy: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Score and length of each pair's best alignment; ``greedy``: cells take the move of the best score a column."""
        n, nu, nv = self.scores.shape
        opened, longer = self.by.gap_open, self.by.gap_extend
        charge = np.broadcast_to(np.asarray(charge, dtype=float), n)[:, None]
        key: Callable[[Cells], np.ndarray] = (lambda c: c[1] / c[2]) if greedy else (lambda c: c[0])

        def none() -> Cells:
            return np.full((n, nu + 1), -np.inf), np.full((n, nu + 1), -np.inf), np.ones((n, nu + 1), dtype=np.int64)

        def step(cells: Cells, change: np.ndarray | float, fee: np.ndarray | float = 0.0) -> Cells:
            return cells[0] + change - fee, cells[1] + change, cells[2] + 1

        def moved(cells: Cells) -> Cells:
            """What comes from one symbol of the first string before."""
            out = none()
            for x, y in zip(out, cells, strict=True):
                x[:, 1:] = y[:, :-1]
            return out

        def either(first: np.ndarray, a: Cells, b: Cells) -> Cells:
            return tuple(np.where(first, x, y) for x, y in zip(a, b, strict=True))

        mid, along, down, before = none(), none(), none(), none()
        for x in mid:
            x[:, 0] = 0
        score, length = np.zeros(n), np.zeros(n, dtype=np.int64)
        i = np.arange(nu + 1)
        for d in range(1, nu + nv + 1):
            a, b = step(moved(mid), -opened), step(moved(along), -longer)
            along = either(key(a) > key(b), a, b)  # uses up a symbol of the first string
            a, b = step(mid, -opened), step(down, -longer)
            down = either(key(a) > key(b), a, b)
            own = np.zeros((n, nu + 1))
            at = i[(i > 0) & (d - i > 0) & (d - i <= nv)]
            own[:, at] = self.scores[:, at - 1, d - at - 1]
            across = step(moved(before), own, charge)
            before = mid
            mid = either((key(across) > key(along)) & (key(across) > key(down)), across, either(key(along) > key(down), along, down))
            gap = opened + (d - 1) * longer
            for cells, place in ((mid, 0), (down, 0), (mid, d), (along, d)):
                if place <= nu:
                    cells[0][:, place] = cells[1][:, place] = -gap
                    cells[2][:, place] = d
            along[0][:, 0] = along[1][:, 0] = -np.inf
            if d <= nu:
                down[0][:, d] = down[1][:, d] = -np.inf
            if (ends := self.sizes.sum(axis=1) == d).any():
                score[ends] = mid[1][ends, self.sizes[ends, 0]]
                length[ends] = mid[2][ends, self.sizes[ends, 0]]
        return score, length


def aligned(u: str, v: str, by: Scoring, charge: float = 0.0, greedy: bool = False) -> tuple[float, int]:
    """Score and length of the best alignment."""
    score, length = Together([(u, v)], by).best(charge, greedy)
    return float(score[0]), int(length[0])


def _distances(pairs: list[tuple[str, str]], by: Scoring, normalized: bool, tol: float) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        together = Together(pairs, by)
        if not normalized:
            return together.most - together.best()[0]
        score, length = together.best(greedy=True)
        filled = length > 0  # two empty strings are at distance 0
        ratio = np.where(filled, (together.most - score) / np.maximum(length, 1), 0.0)
        moving = filled.copy()
        for _ in range(ROUNDS):
            if not moving.any():
                return ratio
            score, length = together.best(ratio)
            now = np.where(moving, (together.most - score) / np.maximum(length, 1), ratio)
            moving, ratio = moving & (np.abs(now - ratio) >= tol), now
    raise ArithmeticError(f"the normalised distance didn't settle in {ROUNDS} rounds")


def alignment_distances(pairs: list[tuple[str, str]], by: Scoring, normalized: bool = False, tol: float = 1e-7) -> list[float]:
    """Distances of pairs of strings; those of like lengths are aligned together, in a bounded number of cells."""
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    out, at = [0.0] * len(pairs), 0
    while at < len(order):
        stop, cells = at + 1, 0
        while stop < len(order) and (cells := max(cells, (len(pairs[order[stop]][0]) + 1) * (len(pairs[order[stop]][1]) + 1))) * (stop - at) < CELLS:
            stop += 1
        for k, d in zip(order[at:stop], _distances([pairs[k] for k in order[at:stop]], by, normalized, tol).tolist(), strict=True):
            out[k] = d
        at = stop
    return out


def alignment_distance(u: str, v: str, by: Scoring, normalized: bool = False, tol: float = 1e-7) -> float:
    return alignment_distances([(u, v)], by, normalized, tol)[0]


EDIT, MATRIX, OWN = ("levenshtein", "edit"), ("blosum62", "blosum", "pam250", "pam"), ("needleman_wunsch", "needleman-wunsch", "nw", "align", "alignment")


def resolve(name: str) -> str:
    for names in (EDIT, ("blosum62", "blosum"), ("pam250", "pam"), OWN):
        if name.lower() in names:
            return names[0]
    raise ValueError(f"unknown string metric {name!r}")


def is_string_metric(name: str) -> bool:
    return any(name.lower() in names for names in (EDIT, MATRIX, OWN))


def string_distance(name: str, u: Column | str, v: Column | str, mat: dict[str, float] | None = None, gap_open: float = 1, gap_extend: float = 1, normalized: bool = False, tol: float = 1e-7, matrix_dir: str | None = None) -> Column:
    """The distance of two string columns; null if either is null."""
    name = resolve(name)
    u, v = (F.col(c) if isinstance(c, str) else c for c in (u, v))
    if name == EDIT[0] and gap_open == gap_extend == 1 and not normalized:
        return F.levenshtein(u, v).cast("double")
    if name == EDIT[0]:
        matrix = None
    elif name in MATRIX and mat is None:
        if matrix_dir is None:
            raise ValueError(f"{name} takes its scores from a table: give mat or matrix_dir")
        matrix = named_matrix(name, matrix_dir)
    elif mat is None:
        raise ValueError(f"{name} needs a score matrix")
    else:
        matrix = checked(mat)
    by = Scoring(matrix, float(gap_open), float(gap_extend))

    @F.arrow_udf("double")
    def run(us: pa.Array, vs: pa.Array) -> pa.Array:
        rows = [None if a is None or b is None else (a, b) for a, b in zip(us.to_pylist(), vs.to_pylist(), strict=True)]
        different = list(dict.fromkeys(p for p in rows if p is not None))
        known = dict(zip(different, alignment_distances(different, by, normalized, tol), strict=True))
        return pa.array([None if p is None else known[p] for p in rows], pa.float64())

    return run(u, v)
