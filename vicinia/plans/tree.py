"""A medoid tree: two levels of Voronoi cells whose number grows with the table.

The first medoids are coarse; each medoid is listed under its ``cover`` nearest coarse ones.
A row is compared with the coarse medoids, then with those listed under its ``opened``
nearest, and is kept under the ``spill`` nearest of them. A query asks for the cells of its
nearest medoids, in order of distance, and meets the rows that share ``votes`` cells or
more with it. With m near 2 sqrt(n) medoids a cell holds about spill sqrt(n) / 2 rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinia.operators import metrics
from vicinia.operators.blocks import cdist
from vicinia.plans.families import CELLS, NONE, Family

#: Medoids at most: they go through the driver and into each task.
MEDOIDS = 1 << 16


def medoid_count(n: int) -> int:
    """2 sqrt(n), a twentieth of the rows at most, ``MEDOIDS`` at most."""
    return max(2, min(n // 20, int(2 * n**0.5), MEDOIDS))


@dataclass
class MedoidTree(Family):
    """Codes: the numbers of a row's nearest medoids, in order of distance, the first of equals."""

    medoids: np.ndarray  # (m, dim), the coarse ones first
    coarse: int
    spill: int = 12
    cover: int = 2
    opened: int = 4
    votes: int = 1
    metric: str = "euclidean"
    parameters: dict = field(default_factory=dict)

    def __post_init__(self):
        self.L, self.k = 1, 1
        if not 1 <= self.coarse <= len(self.medoids):
            raise ValueError("coarse is at least 1 and at most the number of medoids")
        if min(self.spill, self.cover, self.opened, self.votes) < 1:
            raise ValueError("spill, cover, opened and votes are at least 1")
        self.columns, places = np.unique(self.medoids, axis=0, return_inverse=True)  # equal medoids are one column, so their ties stay exact
        self.places = places.reshape(-1)
        self.squares = (self.columns**2).sum(axis=1)
        top = np.arange(self.coarse)
        near = np.argsort(self._far(self.medoids, top), axis=1, kind="stable")[:, : self.cover]
        self.under = [np.flatnonzero((near == c).any(axis=1)) for c in top]

    @classmethod
    def draw(cls, points: DataFrame, order: Column | None = None, n: int | None = None, spill: int = 12, probes: int = 16, metric: str = "euclidean", id_col: str = "id", vec_col: str = "vec", **parameters) -> MedoidTree:
        """Medoids: the first rows in an order that doesn't hang on the vectors. A row opens two thirds of the coarse cells; votes are about one more than the cells that a query of ``probes`` shares with a row by chance."""
        metric = metrics.resolve(metric)
        parameters = parameters or metrics.fit(metric, points, vec_col)
        n = points.count() if n is None else n
        m = medoid_count(n)
        rows = points.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        found = rows.orderBy(F.xxhash64("id") if order is None else order, "id").limit(m).toArrow()  # ``MEDOIDS`` at most
        if found.num_rows < 2:
            raise ValueError("a tree needs two rows")
        vec = found["vec"].combine_chunks().flatten().to_numpy().reshape(found.num_rows, -1)
        coarse = int(np.ceil(len(vec) ** 0.5))
        return cls(vec, coarse, spill, opened=-(-2 * coarse // 3), votes=int(spill * probes / len(vec) + 1.1), metric=metric, parameters=parameters)

    @property
    def dim(self) -> int:
        return self.medoids.shape[1]

    def _far(self, block: np.ndarray, which: np.ndarray) -> np.ndarray:
        """What orders these medoids of each row by distance."""
        used, back = np.unique(self.places[which], return_inverse=True)
        if self.metric in ("euclidean", "sqeuclidean"):
            d = self.squares[used] - 2 * block @ self.columns[used].T
        else:
            d = cdist(self.metric, block, self.columns[used], **self.parameters)
        return np.where(np.isnan(d), np.inf, d)[:, back.reshape(-1)]

    def _lists(self, block: np.ndarray, most: int) -> np.ndarray:
        """The nearest medoids of each row among those under its opened coarse cells; NONE where there are fewer."""
        out = np.full((len(block), min(most, len(self.medoids))), NONE, np.int64)
        step = max(1, CELLS // len(self.medoids))
        for at in range(0, len(block), step):
            rows = block[at : at + step]
            near = np.argsort(self._far(rows, np.arange(self.coarse)), axis=1, kind="stable")[:, : self.opened]
            d, seen = np.full((len(rows), len(self.medoids)), np.inf), np.zeros((len(rows), len(self.medoids)), bool)
            for c, members in enumerate(self.under):
                own = np.flatnonzero((near == c).any(axis=1))
                if len(own) and len(members):
                    d[np.ix_(own, members)] = self._far(rows[own], members)
                    seen[np.ix_(own, members)] = True
            order = np.argsort(d, axis=1, kind="stable")[:, : out.shape[1]]
            out[at : at + step] = np.where(np.take_along_axis(seen, order, 1), order, NONE)
        return out

    def codes(self, block: np.ndarray) -> np.ndarray:
        return self._lists(block, 1)[..., None]

    def entries(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = self._lists(block, self.spill)
        return np.zeros(lists.shape[1], np.int64), lists[..., None]

    def probed_entries(self, block: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        lists = self._lists(block, probes)
        return np.zeros(lists.shape[1], np.int64), lists[..., None]

    def key(self, codes: Column) -> Column:
        return codes[0].cast("long")
