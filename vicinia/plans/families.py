"""Locality-sensitive hash families: L tables of k codes for each row.

A family is drawn once on the driver from a seed (a few medoids, signs or projections)
and then hashes any table of vectors in Arrow batches, without a shuffle. Codes become
one key a table: bit-packed in a BIGINT, or in decimal places where codes are unbounded.

Probing is directed by the query: each code has alternatives with a cost (how much nearer
its own medoid is than another, how far a projection lies from its boundary), the cost of a
key is the sum over its codes, and a query asks for the keys of least cost in each table.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinia.functions import encoding, sampling
from vicinia.functions.stable import stable
from vicinia.operators import metrics
from vicinia.operators.blocks import cdist


#: Distances of a block of rows to chosen medoids that are held at once.
CELLS = 1 << 22
#: In place of a code that a row doesn't have.
NONE = -(2**31)


class Family:
    """L tables of k codes; ``metric`` and ``parameters`` re-rank candidates."""

    L: int
    k: int
    metric: str
    parameters: dict

    def codes(self, block: np.ndarray) -> np.ndarray:
        """Codes of a block of rows, shape (rows, L, k)."""
        raise NotImplementedError

    def alternatives(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values that each code may take instead and their costs, the own value with cost 0 first: two arrays (rows, L, k, values)."""
        raise NotImplementedError

    def key(self, codes: Column) -> Column:
        raise NotImplementedError

    #: Entries that a row and a query must share to meet.
    votes = 1

    def entries(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tables (entries,) and codes (rows, entries, k) under which rows are found."""
        return np.arange(self.L), self.codes(block)

    def probed_entries(self, block: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``entries``, of queries: the ``probes`` keys of least cost in each table."""
        if probes == 1:
            return self.entries(block)
        values, costs = self.alternatives(block)
        n, L, k, width = values.shape
        codes, cost = np.zeros((n, L, 1, 0), np.int64), np.zeros((n, L, 1))
        for j in range(k):  # the least sums so far hold the beginnings of all least sums
            total = (cost[..., None] + costs[:, :, j, None]).reshape(n, L, -1)
            order = np.argsort(total, axis=-1, kind="stable")[..., :probes]
            cost = np.take_along_axis(total, order, -1)
            codes = np.concatenate((np.take_along_axis(codes, (order // width)[..., None], 2), np.take_along_axis(values[:, :, j], order % width, -1)[..., None]), axis=-1)
        return np.repeat(np.arange(L), codes.shape[2]), codes.reshape(n, -1, k)

    def arrays(self, b: pa.RecordBatch) -> np.ndarray:
        """The vectors of a batch (id, vec)."""
        block = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        if block.shape[1] != self.dim:
            raise ValueError(f"vectors of {self.dim} dimensions are indexed, not of {block.shape[1]}")
        return block

    @property
    def dim(self) -> int:
        raise NotImplementedError

    @property
    def values(self) -> int | None:
        """How many values a code may have; None: any number."""
        return None

    def _blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Batches of (id, vec) with the codes of their rows, shape (rows, L, k)."""
        for b in batches:
            if not b.num_rows:
                continue
            yield b, self.codes(self.arrays(b)).astype(np.int32)

    def tagged(self, points: DataFrame, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
        """A row for each point: id, vec and its ``codes``, an array of k codes for each table."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, codes in self._blocks(batches):
                each = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, self.k, dtype=np.int32), pa.array(codes.ravel()))
                lists = pa.ListArray.from_arrays(np.arange(0, len(each) + 1, self.L, dtype=np.int32), each)
                yield pa.RecordBatch.from_arrays([*b.columns, lists], ["id", "vec", "codes"])

        rows = points.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("codes", T.ArrayType(T.ArrayType(T.IntegerType())))]))

    def hashed(self, points: DataFrame, id_col: str = "id", vec_col: str = "vec", probes: int | None = None) -> DataFrame:
        """A row for each point and entry (``probes``: for each key that a query asks for): id, table_id, codes, bucket."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                tables, codes = self.entries(self.arrays(b)) if probes is None else self.probed_entries(self.arrays(b), probes)
                known = np.flatnonzero(codes[..., 0].ravel() != NONE)
                lists = pa.ListArray.from_arrays(np.arange(0, len(known) * codes.shape[2] + 1, codes.shape[2], dtype=np.int32), pa.array(codes.reshape(-1, codes.shape[2])[known].astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(known // len(tables))), pa.array(tables[known % len(tables)].astype(np.int32)), lists], ["id", "table_id", "codes"])

        rows = points.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("table_id", T.IntegerType()), T.StructField("codes", T.ArrayType(T.IntegerType()))])
        return rows.mapInArrow(run, schema).withColumn("bucket", self.key(F.col("codes")))

    def to_bytes(self) -> bytes:
        """The drawn arrays and parameters, without code."""
        out = io.BytesIO()
        np.savez(out, **{f.name: getattr(self, f.name) for f in fields(self) if f.name != "parameters"}, kind=type(self).__name__, parameters=json.dumps(self.parameters))
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Family:
        with np.load(io.BytesIO(data), allow_pickle=False) as held:
            kind = {c.__name__: c for c in Family.__subclasses__()}[str(held["kind"])]
            plain = {k: v if v.ndim else v.item() for k, v in held.items() if k not in ("kind", "parameters")}
            return kind(**plain, parameters=json.loads(str(held["parameters"])))

    def _check(self) -> None:
        if self.L < 1:
            raise ValueError("L is at least 1")
        if self.k < 1:
            raise ValueError("k is at least 1")


@dataclass
class Voronoi(Family):
    """Code: which of w medoids is nearest, the first of equals; k subsets of the m medoids of each of L tables."""

    medoids: np.ndarray  # distinct medoids
    chosen: np.ndarray  # (L, k, w): rows of medoids
    metric: str = "euclidean"
    parameters: dict = field(default_factory=dict)

    def __post_init__(self):
        self.L, self.k, self.w = self.chosen.shape
        self.bits = encoding.bits_for(self.w)
        self._check()
        if self.w < 2:
            raise ValueError("w is at least 2")
        if self.k * self.bits > 63:
            raise ValueError(f"{self.k} codes of {self.bits} bits don't fit a key")
        used, places = np.unique(self.chosen, return_inverse=True)  # distances to these only
        self.columns, same = np.unique(self.medoids[used], axis=0, return_inverse=True)
        self.places = same.reshape(-1)[places].reshape(self.chosen.shape)
        self.squares = (self.columns**2).sum(axis=1)

    @classmethod
    def draw(cls, points: DataFrame, L: int = 1, k: int = 4, m: int = 10, w: int = 3, metric: str = "euclidean", seed: int = 0, id_col: str = "id", vec_col: str = "vec", **parameters) -> Voronoi:
        if not 2 <= w <= m:
            raise ValueError("w is at least 2 and at most m")
        metric = metrics.resolve(metric)
        parameters = parameters or metrics.fit(metric, points, vec_col)
        _, unique, drawn = sampling.medoids(points, m, L, seed, id_col, vec_col)
        rng = np.random.default_rng(seed)
        return cls(unique, np.stack([drawn[t][sampling.sample_indices(m, k, w, rng=rng)] for t in range(L)]), metric, parameters)

    @property
    def dim(self) -> int:
        return self.medoids.shape[1]

    @property
    def values(self) -> int:
        return self.w

    def codes(self, block: np.ndarray) -> np.ndarray:
        rows = max(1, CELLS // self.chosen.size)
        parts = [self._nearest(block[at : at + rows]) for at in range(0, len(block), rows)]
        return np.concatenate(parts) if parts else np.zeros((0, self.L, self.k), dtype=np.int64)

    def alternatives(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self._far(block)
        order = np.argsort(d, axis=-1, kind="stable")
        d = np.take_along_axis(d, order, -1)
        return order, d - d[..., :1]

    def _nearest(self, block: np.ndarray) -> np.ndarray:
        return self._far(block).argmin(axis=-1)

    def _far(self, block: np.ndarray) -> np.ndarray:
        """What orders the chosen medoids of each row by distance: (rows, L, k, w)."""
        if self.metric in ("euclidean", "sqeuclidean"):
            # of |x - m|^2 what depends on m, as one product; equal medoids are one column, so their ties stay exact
            d = self.squares - 2 * block @ self.columns.T
        else:
            d = cdist(self.metric, block, self.columns, **self.parameters)
        return np.where(np.isnan(d), np.inf, d)[:, self.places]

    def key(self, codes: Column) -> Column:
        return encoding.encode_by_bits(codes, self.k, self.bits)


@dataclass
class Cosine(Family):
    """Code: whether the dot product with a vector of signs is positive."""

    signs: np.ndarray  # (L, k, dim) of +1 and -1
    metric: str = "cosine"
    parameters: dict = field(default_factory=dict)

    def __post_init__(self):
        self.L, self.k, _ = self.signs.shape
        self._check()
        if self.k > 63:
            raise ValueError("k is at most 63")

    @classmethod
    def draw(cls, dim: int, L: int = 1, k: int = 4, seed: int = 0) -> Cosine:
        return cls(np.random.default_rng(seed).integers(0, 2, (L, k, dim)) * 2.0 - 1)

    @property
    def dim(self) -> int:
        return self.signs.shape[2]

    @property
    def values(self) -> int:
        return 2

    def codes(self, block: np.ndarray) -> np.ndarray:
        return (block @ self.signs.reshape(-1, self.dim).T > 0).reshape(-1, self.L, self.k)

    def alternatives(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (block @ self.signs.reshape(-1, self.dim).T).reshape(-1, self.L, self.k)
        own = (at > 0).astype(np.int64)
        return np.stack((own, 1 - own), axis=-1), np.stack((np.zeros_like(at), at**2), axis=-1)

    def key(self, codes: Column) -> Column:
        return encoding.encode_by_bits(codes, self.k, 1)


@dataclass
class Stable(Family):
    """Code: floor((a . x + b) / r) with a drawn from the el-stable law and b from [0, r)."""

    projections: np.ndarray  # (L, k, dim)
    shifts: np.ndarray  # (L, k)
    r: float = 1.0
    metric: str = "euclidean"
    parameters: dict = field(default_factory=dict)
    width: int = 8

    def __post_init__(self):
        self.L, self.k, _ = self.projections.shape
        self._check()
        if not self.r > 0:
            raise ValueError("r is positive")

    @staticmethod
    def law(el: float | None, metric: str | None) -> tuple[float, str, dict]:
        """The stability index and the metric that re-ranks, from either or both."""
        name = metric.lower() if metric else None
        if el is None and name is None:
            raise ValueError("el or a metric is needed")
        if name in (None, "lnorm", "l-norm", "pnorm", "p-norm", "minkowski"):
            if el is None:
                raise ValueError(f"{metric} needs el")
        elif metrics.resolve(name) == "euclidean":
            if el not in (None, 2):
                raise ValueError("euclidean goes with el 2")
            el = 2
        else:
            raise NotImplementedError(f"no stable law for {metric}")
        if not 0 < el <= 2:
            raise ValueError("el lies in (0, 2]")
        if el == 2:
            return 2.0, "euclidean", {}
        return float(el), "minkowski", {"p": max(1.0, float(el))}

    @classmethod
    def draw(cls, dim: int, L: int = 1, k: int = 4, r: float = 1.0, el: float | None = 2, metric: str | None = "euclidean", seed: int = 0) -> Stable:
        alpha, name, parameters = cls.law(el, metric)
        rng = np.random.default_rng(seed)
        return cls(stable(alpha, size=(L, k, dim), rng=rng, convention="reference"), rng.uniform(0, r, (L, k)), r, name, parameters)

    @property
    def dim(self) -> int:
        return self.projections.shape[2]

    def codes(self, block: np.ndarray) -> np.ndarray:
        return np.floor(self._at(block))

    def _at(self, block: np.ndarray) -> np.ndarray:
        return ((block @ self.projections.reshape(-1, self.dim).T).reshape(-1, self.L, self.k) + self.shifts) / self.r

    def alternatives(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self._at(block)
        own = np.floor(at).astype(np.int64)
        rest = at - own
        return np.stack((own, own - 1, own + 1), axis=-1), np.stack((np.zeros_like(at), rest**2, (1 - rest) ** 2), axis=-1)

    def key(self, codes: Column) -> Column:
        if self.k * self.width <= 38:
            return encoding.encode_by_place(codes, self.k, self.width)
        return F.array_join(codes.cast("array<string>"), ",")
