"""All-pairs, listed-pairs and set distances over tables of vectors or, by the names of string metrics, of strings.

Products of vectors are taken in blocks (``product``): blocks of ROWS rows are dealt over a
grid of tasks, however few files the tables lie in, so a row of the join is a product of
ROWS x ROWS distances, and a task holds one block pair's distances at a time. ``places``
rounds there too: Spark's round goes through a decimal a row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinia.operators import alignment, metrics
from vicinia.operators.blocks import cdist, each_pair
from vicinia.sources.workspace import Workspace

#: Rows of a block of a product.
ROWS = 256
#: Rows of a block where only the nearest leave it, rows whose distances are held at once there, and bytes of one side that a task holds.
LONG, STEP, HELD = 2048, 128, 1 << 28
#: Rows about that are measured first to bound the farthest from below, and pairs of groups with such a bound.
SEEDS, FLOORS = 4096, 1 << 14
Metric = str | Callable[[np.ndarray, np.ndarray], float]


def broadcasting(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Mark a callable metric that works along the last axis, so that blocks of vectors broadcast; others are called a pair at a time."""
    f.broadcasts = True
    return f


def metric_column(metric: Metric, u: Column, v: Column, dim: int | None = None, **parameters) -> Column:
    """A named metric of vectors or strings, or a callable f(u, v) of vectors as an Arrow UDF."""
    if isinstance(metric, str):
        return alignment.string_distance(metric, u, v, **parameters) if alignment.is_string_metric(metric) else metrics.distance(metric, u, v, dim, **parameters)
    if not callable(metric):
        raise ValueError("a metric is a name or a callable")

    @F.arrow_udf("double")
    def run(us: pa.Array, vs: pa.Array) -> pa.Array:
        return pa.array([float(metric(np.asarray(a), np.asarray(b), **parameters)) for a, b in zip(us.to_pylist(), vs.to_pylist(), strict=True)], pa.float64())

    return run(u.cast("array<double>"), v.cast("array<double>"))


def _sides(a: DataFrame, b: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    return (
        a.select(F.col(id_col).alias("id_a"), F.col(vec_col).alias("vec_a")),
        b.select(F.col(id_col).alias("id_b"), F.col(vec_col).alias("vec_b")),
    )


def _fitted(metric: Metric, frames: list[DataFrame], vec_col: str, parameters: dict) -> dict:
    if isinstance(metric, str) and not alignment.is_string_metric(metric) and metrics.resolve(metric) in ("seuclidean", "mahalanobis") and not {"V", "VI"} & set(parameters):
        return parameters | metrics.fit(metric, metrics.stacked(frames, vec_col), vec_col)
    return parameters


def _to(places: int | None, x: Column) -> Column:
    return x if places is None else F.round(x, places) + 0.0


def nearest_decimal(x: np.ndarray, places: int) -> np.ndarray:
    """To ``places`` decimals, halves away from zero, without negative zeros; what has no such decimal stays."""
    with np.errstate(over="ignore", invalid="ignore"):
        y = x * 10.0**places
        whole = np.trunc(y)
        y -= whole
        y *= 2
        whole += np.trunc(y, out=y)
        whole /= 10.0**places
    whole += 0.0
    finite = np.isfinite(whole)
    return whole if finite.all() else np.where(finite, whole, x)


@lru_cache(16)
def _places(shape: tuple[int, int]) -> tuple[pa.Array, pa.Array]:
    """Row and column of each cell of a block."""
    rows, columns = (pa.array(i.ravel()) for i in np.indices(shape, dtype=np.int32))
    return rows, columns


def _order(a: pa.Array, b: pa.Array) -> bool | None:
    """Whether all of a is less than all of b (True) or none of it is (False)."""
    if a.null_count or b.null_count:
        return None
    x, y = pc.min_max(a), pc.min_max(b)
    return True if pc.less(x["max"], y["min"]).as_py() else False if pc.less_equal(y["max"], x["min"]).as_py() else None


def _is_string(metric: Metric) -> bool:
    return isinstance(metric, str) and alignment.is_string_metric(metric)


def pairwise(a: DataFrame, b: DataFrame, metric: Metric, id_col: str = "id", vec_col: str = "vec", dim: int | None = None, places: int | None = None, **parameters) -> DataFrame:
    """Distance of every row of a to every row of b, to ``places`` decimals if given: id_a, id_b, distance.

    The answer has len(a) * len(b) rows by definition. Vectors meet in blocks over a grid of
    tasks; strings in a product that Spark plans.
    """
    if not _is_string(metric):
        return _distances(a, b, metric, id_col, vec_col, dim, places, parameters, ordered=False)
    left, right = _sides(a, b, id_col, vec_col)
    return left.crossJoin(right).select("id_a", "id_b", _to(places, metric_column(metric, F.col("vec_a"), F.col("vec_b"), dim, **parameters)).alias("distance"))


def listed(pairs: DataFrame, a: DataFrame, b: DataFrame, metric: Metric, id_col: str = "id", vec_col: str = "vec", dim: int | None = None, **parameters) -> DataFrame:
    """Distance of the listed pairs (id_a, id_b) only: two equi-joins, no product."""
    parameters = _fitted(metric, [a, b], vec_col, parameters)
    left, right = _sides(a, b, id_col, vec_col)
    return pairs.select("id_a", "id_b").join(left, "id_a").join(right, "id_b").select("id_a", "id_b", metric_column(metric, F.col("vec_a"), F.col("vec_b"), dim, **parameters).alias("distance"))


def condensed(data: DataFrame, metric: Metric, id_col: str = "id", vec_col: str = "vec", dim: int | None = None, places: int | None = None, **parameters) -> DataFrame:
    """Each unordered pair once: id_a < id_b.

    Blocks hold ranges of ids, so of two blocks one order is dropped before any distance.
    """
    if not _is_string(metric):
        return _distances(data, data, metric, id_col, vec_col, dim, places, parameters, ordered=True)
    left, right = _sides(data, data, id_col, vec_col)
    return left.join(right, F.col("id_a") < F.col("id_b")).select("id_a", "id_b", _to(places, metric_column(metric, F.col("vec_a"), F.col("vec_b"), dim, **parameters)).alias("distance"))


def square(pairs: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The full symmetric matrix of a condensed one, with a diagonal of zeros."""
    back = pairs.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), "distance")
    own = ids.select(F.col(id_col).alias("id_a"), F.col(id_col).alias("id_b"), F.lit(0.0).alias("distance"))
    return pairs.unionByName(back).unionByName(own)


def in_blocks(df: DataFrame, by: list[str], id_col: str, vec_col: str, side: str, keys: str | None = None, most: int = ROWS) -> DataFrame:
    """Up to ``most`` rows as one: their ids, vectors in one array, these vectors' sizes (null: no vector or one with a null in it) and, in by's order, group columns as JSON; with ``keys``, a column of lists of numbers, also these in one array and their sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, most):
                part = b.slice(at, most)
                columns = (part.column(0), part.column(1).flatten(), pc.list_value_length(part.column(1)), part.column(2), *((part.column(3).flatten(), pc.list_value_length(part.column(3))) if keys else ()))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.array([0, len(c)], dtype=np.int32), c) for c in columns], names)

    names = [f"{c}_{side}" for c in ("ids", "vecs", "sizes", "groups", *(("keys", "counts") if keys else ()))]
    vec = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).alias("id"), F.when(~F.exists(vec, lambda x: x.isNull()), vec).alias("vec"), F.to_json(F.struct(*[F.col(c) for c in by])).alias("group") if by else F.lit("{}").alias("group"), *([F.col(keys).alias("keys")] if keys else []))
    kinds = (rows.schema["id"].dataType, T.DoubleType(), T.IntegerType(), T.StringType(), *((T.LongType(), T.IntegerType()) if keys else ()))
    return rows.mapInArrow(run, T.StructType([T.StructField(c, T.ArrayType(k)) for c, k in zip(names, kinds, strict=True)]))


def side(df: DataFrame) -> int:
    return math.ceil(2 * math.sqrt(df.sparkSession.sparkContext.defaultParallelism))


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of blocks, over a grid of about four tasks a core; a left block's pairs follow each other."""
    n = side(left)
    return left.repartition(n).crossJoin(right.repartition(n).hint("shuffle_replicate_nl"))


def matrices(vecs: pa.Array, sizes: pa.Array, dim: int | None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The vectors of a block by size: size, their places, a matrix."""
    n = pc.fill_null(sizes, -1).to_numpy(zero_copy_only=False)
    flat, known = vecs.to_numpy(zero_copy_only=False), np.unique(n)
    if dim and ((n >= 0) & (n < dim)).any():
        raise ValueError(f"vectors of {dim} dimensions are compared, not of {n[n >= 0].min()}")
    if len(known) == 1 and known[0] >= 0:
        return [(dim or int(known[0]), np.arange(len(n)), flat.reshape(len(n), -1)[:, :dim])]
    start = np.cumsum(np.maximum(n, 0)) - np.maximum(n, 0)
    out = [(int(k), np.flatnonzero(n == k)) for k in known if k >= 0]
    return [(min(k, dim or k), at, flat[start[at][:, None] + np.arange(min(k, dim or k))]) for k, at in out]


def _called(metric: Callable, x: np.ndarray, y: np.ndarray, parameters: dict) -> np.ndarray:
    if getattr(metric, "broadcasts", False):
        return np.asarray(each_pair(metric)(x, y, **parameters), dtype=float)
    return np.array([[metric(u, v, **parameters) for v in y] for u in x], dtype=float)


def block_distances(metric: Metric, a: list, b: list, shape: tuple[int, int], parameters: dict) -> tuple[np.ndarray, np.ndarray | None]:
    """Distances of two blocks' vectors and, if any are, which are unknown: those of no vector or of two sizes."""
    d, known = np.zeros(shape), np.zeros(shape, dtype=bool)
    for size, rows, x in a:
        for other, columns, y in b:
            if size == other:
                part = cdist(metric, x, y, **parameters) if isinstance(metric, str) else _called(metric, x, y, parameters)
                if part.shape == shape:
                    return part, None
                d[np.ix_(rows, columns)], known[np.ix_(rows, columns)] = part, True
    return d, ~known


def _distances(a: DataFrame, b: DataFrame, metric: Metric, id_col: str, vec_col: str, dim: int | None, places: int | None, parameters: dict, ordered: bool) -> DataFrame:
    """Distance of every row of a to every row of b or, ``ordered``, to those of a greater id."""
    if isinstance(metric, str):
        metrics.check(metric, **parameters)
    elif not callable(metric):
        raise ValueError("a metric is a name or a callable")
    parameters = _fitted(metric, [a] if ordered else [a, b], vec_col, parameters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids_a, x, sizes_a, _, ids_b, y, sizes_b, _ = (c[row].values for c in batch.columns)
                whole = True if not ordered else _order(ids_a, ids_b)
                if whole is False:
                    continue
                shape = len(ids_a), len(ids_b)
                d, unknown = block_distances(metric, matrices(x, sizes_a, dim), matrices(y, sizes_b, dim), shape, parameters)
                d = d if places is None else nearest_decimal(d, places)
                rows, columns = _places(shape)
                out = pa.RecordBatch.from_arrays([ids_a.take(rows), ids_b.take(columns), pa.array(d.ravel(), mask=None if unknown is None else unknown.ravel())], ["id_a", "id_b", "distance"])
                yield out if whole else out.filter(pc.less(out.column(0), out.column(1)))

    if ordered:  # a block's ids follow each other
        a = b = a.repartitionByRange(side(a), id_col).sortWithinPartitions(id_col)
    left, right = (in_blocks(df, [], id_col, vec_col, which) for df, which in ((a, "a"), (b, "b")))
    schema = T.StructType([T.StructField("id_a", a.schema[id_col].dataType), T.StructField("id_b", b.schema[id_col].dataType), T.StructField("distance", T.DoubleType())])
    return product(left, right).mapInArrow(run, schema)


def _nearest(name: str | None, metric: Metric, x: np.ndarray, y: np.ndarray, parameters: dict) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the first nearest row of y, and its distance; NaN is farthest.

    Euclidean ones are sought by a matrix product, and what comes as near as its error
    lets it is measured as ``cdist`` does.
    """
    if name is None or metrics.resolve(name) != "euclidean" or not (np.isfinite(x).all() and np.isfinite(y).all()):
        d = cdist(name, x, y, **parameters) if name else _called(metric, x, y, parameters)
        at = np.where(np.isnan(d), np.inf, d).argmin(axis=1)
        return at, d[np.arange(len(d)), at]
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    error = 1e-12 * x.shape[1] * (xx + yy.max())
    left, right = np.column_stack((-2 * x, np.ones(len(x)))), np.column_stack((y, yy)).T
    out = np.empty(len(x), dtype=np.int64), np.empty(len(x))
    for i in range(0, len(x), STEP):
        near = left[i : i + STEP] @ right
        cells = np.flatnonzero(near <= (near.min(axis=1) + error[i : i + STEP])[:, None])
        rows, columns = np.divmod(cells, len(y))
        d = np.sqrt(((x[i + rows] - y[columns]) ** 2).sum(-1))
        if len(rows) > len(near):
            first = np.lexsort((columns, d, rows))
            first = first[np.searchsorted(rows[first], np.arange(len(near)))]
            columns, d = columns[first], d[first]
        out[0][i : i + STEP], out[1][i : i + STEP] = columns, d
    return out


def directed_hausdorff(a: DataFrame, b: DataFrame, metric: Metric = "euclidean", by: list[str] | None = None, id_col: str = "id", vec_col: str = "vec", dim: int | None = None, **parameters) -> DataFrame:
    """The row of a that is farthest from its nearest row of b: distance, id_a, id_b; for each value of ``by`` of a and of b if given (columns ``*_a``, ``*_b``).

    Ties go to the smaller ids. Blocks of rows meet blocks of rows, a task keeps the
    nearest so far of each row of its left block and group of b, and only those leave the
    join. Then two aggregations: the nearest of each row, then the farthest of those.

    Of a large table about SEEDS rows come first. The farthest of them bounds the answer
    from below, and a row that is found nearer to any row of b can't be the answer, so it
    isn't compared further. A task meets as much of b as HELD allows.
    """
    by = by or []
    parameters = _fitted(metric, [a, b], vec_col, parameters)
    n, others = a.count(), b.count()
    if n <= 2 * SEEDS:
        near = _nearest_in_groups(a, b, metric, by, id_col, vec_col, parameters, {}, side(a), long=False)
    else:
        seeds = a.where(F.pmod(F.xxhash64(id_col), F.lit(n // SEEDS)) == 0)
        first = _nearest_in_groups(seeds, b, metric, by, id_col, vec_col, parameters, {}, side(a))
        ws = Workspace(a.sparkSession, "hausdorff")
        first = ws.save(first, "seeds")
        rows = _farthest(first).limit(FLOORS + 1).collect()  # more pairs of groups go without a bound
        floors = {(r["group_a"], r["group_b"]): (-r["far"]["less"], r["far"]["id_a"]) for r in rows} if len(rows) <= FLOORS else {}
        width = dim or a.agg(F.max(F.size(vec_col))).first()[0] or 1
        near = _nearest_in_groups(a, b, metric, by, id_col, vec_col, parameters, floors, max(1, -(-others * width * 8 // HELD)) if floors else side(a)).unionByName(first)
    far = _farthest(near)
    parts = []
    for which, df in (("a", a), ("b", b)):
        kinds = T.StructType([T.StructField(c, df.schema[c].dataType) for c in by])
        parts += [F.from_json(f"group_{which}", kinds)[c].alias(f"{c}_{which}") for c in by]
    return far.select(*parts, (-F.col("far.less")).alias("distance"), "far.id_a", "far.id_b")


def _farthest(near: DataFrame) -> DataFrame:
    return near.groupBy("group_a", "group_b").agg(F.min(F.struct((-F.col("near.distance")).alias("less"), "id_a", F.col("near.id_b").alias("id_b"))).alias("far"))


def _nearest_in_groups(a: DataFrame, b: DataFrame, metric: Metric, by: list[str], id_col: str, vec_col: str, parameters: dict, floors: dict, columns: int, long: bool = True) -> DataFrame:
    """(group_a, group_b, id_a, near): the nearest row of each group of b, which is dealt over ``columns`` tasks a row of a.

    ``floors``: by groups a distance and the id of a row of a that is as far. A row that is found
    nearer, or as near with a greater id, comes with what it was found at, or not at all.
    """
    name = metric if isinstance(metric, str) else None
    whole = columns == 1

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, best = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            for group, (least, ids, left, _, _) in best.items():
                kept = pa.array(left if whole else np.arange(len(least)))
                yield pa.RecordBatch.from_arrays([last[2].take(kept), pa.array([group] * len(kept), pa.string()), last[0].take(kept), ids.take(kept), pa.array(least).take(kept)], ["group_a", "group_b", "id_a", "id_b", "distance"])

        def begun(group: str, kind: pa.DataType) -> list:
            """Nearest distances and ids so far, the rows that are compared still, their floors and whether they lose a tie."""
            floor = [floors.get((own, group), (-np.inf, None)) for own in last[2].to_pylist()]
            later = np.array([i is not None and own is not None and own > i for own, (_, i) in zip(last[0].to_pylist(), floor, strict=True)], dtype=bool)
            size = len(last[0])
            return [np.full(size, np.nan), pa.nulls(size, kind), np.arange(size), np.array([f for f, _ in floor], dtype=float), later]

        for batch in batches:
            for row in range(batch.num_rows):
                ids_a, x, _, groups_a, ids_b, y, _, groups_b = (c[row].values for c in batch.columns)
                if last is None or not (last[0].equals(ids_a) and last[1].equals(x) and last[2].equals(groups_a)):
                    yield from done()
                    last, best = (ids_a, x, groups_a), {}
                x, y = (m.to_numpy().reshape(n, -1) for m, n in ((x, len(ids_a)), (y, len(ids_b))))
                order = pc.sort_indices(ids_b)
                y, ids_b, groups_b = y[order.to_numpy()], ids_b.take(order), groups_b.take(order).dictionary_encode()
                of = groups_b.indices.to_numpy()
                for k, group in enumerate(groups_b.dictionary.to_pylist()):
                    fresh = group not in best
                    state = best.setdefault(group, None) or begun(group, ids_b.type)
                    best[group], left = state, state[2]
                    if not len(left):
                        continue
                    own = np.flatnonzero(of == k)
                    at, least = _nearest(name, metric, x if len(left) == len(x) else x[left], y if len(own) == len(y) else y[own], parameters)
                    ids = ids_b.take(pa.array(own[at]))
                    if not fresh:
                        before, known = state[0][left], state[1].take(pa.array(left))
                        tied = ((least == before) | (np.isnan(least) & np.isnan(before))) & pc.less(ids, known).to_numpy(zero_copy_only=False)
                        better = (least < before) | (np.isnan(before) & ~np.isnan(least)) | tied
                        least, ids = np.where(better, least, before), pc.if_else(pa.array(better), ids, known)
                    state[0][left] = least
                    if len(left) == len(state[0]):
                        state[1] = ids
                    else:
                        mask = np.zeros(len(state[0]), dtype=bool)
                        mask[left] = True
                        state[1] = pc.replace_with_mask(state[1], pa.array(mask), ids)
                    floor = state[3][left]
                    with np.errstate(invalid="ignore"):
                        out = (least < floor - 1e-9 * np.abs(floor)) | ((least == floor) & state[4][left])
                    state[2] = left[~out]
        yield from done()

    id_a, id_b = (df.schema[id_col].dataType for df in (a, b))
    schema = T.StructType([T.StructField("group_a", T.StringType()), T.StructField("group_b", T.StringType()), T.StructField("id_a", id_a), T.StructField("id_b", id_b), T.StructField("distance", T.DoubleType())])
    n, most = side(a), LONG if long else ROWS
    if by and long:  # blocks of one group or two
        b = b.repartition(n).sortWithinPartitions(*by)
    left, right = (in_blocks(df, by, id_col, vec_col, which, most=most) for df, which in ((a, "a"), (b, "b")))
    each = left.repartition(max(1, n * n // columns)).crossJoin(right.repartition(columns).hint("shuffle_replicate_nl")).mapInArrow(nearest, schema)
    return each.groupBy("group_a", "group_b", "id_a").agg(F.min(F.struct("distance", "id_b")).alias("near"))
