"""Array files as Spark data sources: ``.npy`` files and headerless records, split by rows.

A source is one file or a folder of parts. Each task reads one range of rows straight from
its place behind the header, so a file of any size is many tasks and a task's memory is a
batch. Ids are row numbers: over the parts in the order of the folder's list (which the
writer leaves) or else of their names. Stores are those of ``pyarrow.fs`` (file, s3, gs,
hdfs, ...); a path without a scheme is a path on this machine.

The writer makes parts of at most ``part_bytes`` bytes (64 MB), so a task holds no more. A task's parts have names of their
own attempt, and the list names those of the attempts that Spark commits, so parts of a
task that failed or ran twice are never read.

Defined cases: a one-dimensional array is one row; an array of no rows gives none; column-major arrays are
read column by column; null vectors, nulls in vectors, vectors of several lengths,
arrays of three dimensions and of other than numbers fail with a message.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

LIST = "_parts.json"
BATCH_BYTES = 4 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    if ":/" not in path:
        path = str(Path(path).absolute())
    elif path.startswith("file:/"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass
class Layout:
    """Where the rows of one part lie."""

    path: str
    kind: str
    begin: int  # of the first number, in bytes
    rows: int
    dim: int
    by_column: bool = False


@dataclass
class RowRange(InputPartition):
    layout: Layout
    first: int
    last: int  # exclusive
    first_id: int


def npy_layout(store: fs.FileSystem, path: str) -> Layout:
    with store.open_input_file(path) as f:
        version = np.lib.format.read_magic(f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, by_column, kind = read(f)
        if kind.kind not in "biuf":
            raise ValueError(f"{path} holds {kind}, numbers are needed")
        if len(shape) > 2:
            raise ValueError(f"{path} has {len(shape)} dimensions, two at most are read")
        rows, dim = shape if len(shape) == 2 else (1, shape[0] if shape else 1)
        return Layout(path, kind.str, f.tell(), rows, dim, by_column and len(shape) == 2)


def record_layout(store: fs.FileSystem, path: str, dim: int, kind: np.dtype) -> Layout:
    size = store.get_file_info(path).size
    if size % (dim * kind.itemsize):
        raise ValueError(f"{path} has {size} bytes, no whole number of records of {dim * kind.itemsize}")
    return Layout(path, kind.str, 0, size // (dim * kind.itemsize), dim)


def read_rows(f, layout: Layout, first: int, last: int) -> np.ndarray:
    kind = np.dtype(layout.kind)
    if layout.by_column:
        columns = [f.read_at((last - first) * kind.itemsize, layout.begin + (j * layout.rows + first) * kind.itemsize) for j in range(layout.dim)]
        return np.column_stack([np.frombuffer(c, kind) for c in columns]).astype(np.float64) if columns else np.empty((last - first, 0))
    width = layout.dim * kind.itemsize
    return np.frombuffer(f.read_at((last - first) * width, layout.begin + first * width), kind).reshape(last - first, layout.dim).astype(np.float64)


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split_bytes = int(options.get("split_bytes", 64 << 20))
        self.records = (int(options["dim"]), np.dtype(options.get("dtype", "<f8"))) if "dim" in options else None

    def _layouts(self) -> list[Layout]:
        store, path = located(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            paths = [path]
        elif store.get_file_info(f"{path}/{LIST}").type == fs.FileType.File:
            with store.open_input_stream(f"{path}/{LIST}") as f:
                return [Layout(f"{path}/{p.pop('path')}", **p) for p in json.loads(f.read())]
        else:
            found = store.get_file_info(fs.FileSelector(path))
            paths = sorted(x.path for x in found if x.type == fs.FileType.File and x.base_name[0] not in "._" and (self.records or x.extension == "npy"))
        with ThreadPoolExecutor(32) as pool:  # a header is one small read
            return list(pool.map(lambda p: record_layout(store, p, *self.records) if self.records else npy_layout(store, p), paths))

    def partitions(self) -> list[RowRange]:
        out, row = [], 0
        for x in self._layouts():
            step = max(1, self.split_bytes // max(1, x.dim * np.dtype(x.kind).itemsize))
            out += [RowRange(x, k, min(k + step, x.rows), row + k) for k in range(0, x.rows, step)]
            row += x.rows
        return out or [RowRange(Layout("", "<f8", 0, 0, 0), 0, 0, 0)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        x = partition.layout
        if partition.first == partition.last:
            return
        step = max(1, BATCH_BYTES // (8 * max(1, x.dim)))
        store, _ = located(self.path)
        with store.open_input_file(x.path) as f:
            for a in range(partition.first, partition.last, step):
                rows = read_rows(f, x, a, min(a + step, partition.last))
                at = partition.first_id + a - partition.first
                vec = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * x.dim, pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(rows))), vec], ["id", "vec"])


@dataclass
class Parts(WriterCommitMessage):
    parts: list[dict]


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path = options["path"]
        self.kind = np.dtype(options.get("dtype", "<f8"))
        self.part_bytes = int(options.get("part_bytes", 64 << 20))
        store, path = located(self.path)
        if store.get_file_info(f"{path}/{LIST}").type == fs.FileType.File and not overwrite:
            raise FileExistsError(f"{self.path} holds arrays, write with mode overwrite to replace them")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        store, path = located(self.path)
        store.create_dir(path)
        attempt, parts, held = uuid.uuid4().hex, [], []

        def put() -> None:
            rows = np.concatenate(held)
            held.clear()
            name = f"part-{attempt}-{len(parts)}.npy"
            with store.open_output_stream(f"{path}/{name}") as f:
                np.lib.format.write_array_header_1_0(f, {"descr": self.kind.str, "fortran_order": False, "shape": rows.shape})
                begin = f.tell()
                f.write(rows.tobytes())
            parts.append({"path": name, "kind": self.kind.str, "begin": begin, "rows": len(rows), "dim": rows.shape[1], "by_column": False})

        for b in iterator:
            vec = b.column(b.schema.get_field_index("vec"))
            sizes = np.diff(vec.offsets.to_numpy())
            flat = vec.flatten()
            if vec.null_count or flat.null_count:
                raise ValueError("a null in the vectors, arrays can't hold one")
            if len(sizes) == 0:
                continue
            dim = held[0].shape[1] if held else parts[0]["dim"] if parts else sizes[0]
            if (sizes != dim).any():
                raise ValueError(f"vectors of {sizes[sizes != dim][0]} and of {dim} numbers in one array")
            rows = flat.to_numpy(zero_copy_only=False).astype(self.kind).reshape(len(sizes), dim)
            most = max(1, self.part_bytes // max(1, dim * self.kind.itemsize))
            while len(rows):
                room = most - sum(map(len, held))
                held.append(rows[:room])
                rows = rows[room:]
                if sum(map(len, held)) == most:
                    put()
        if held:
            put()
        return Parts(parts)

    def commit(self, messages: list[Parts | None]) -> None:
        parts = [p for m in messages if m is not None for p in m.parts]
        if len(dims := sorted({p["dim"] for p in parts})) > 1:
            self.abort(messages)
            raise ValueError(f"vectors of {dims[0]} and of {dims[-1]} numbers in one array")
        store, path = located(self.path)
        store.create_dir(path)
        with store.open_output_stream(f"{path}/{LIST}") as f:
            f.write(json.dumps(parts).encode())

    def abort(self, messages: list[Parts | None]) -> None:
        store, path = located(self.path)
        for p in (p for m in messages if m is not None for p in m.parts):
            store.delete_file(f"{path}/{p['path']}")


class ArraySource(DataSource):
    """``spark.read.format("arrays")``; with an option ``dim`` the files are records without a header."""

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        return "id long, vec array<double>"

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(dict(self.options), overwrite)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(ArraySource)
    return spark.read.format("arrays").options(**options).load(path)


def write(df: DataFrame, path: str, order: str = "id", mode: str = "append", **options) -> None:
    """The vectors as parts of one array, in order of ``order``: sorted by range, so parts are written side by side."""
    spark = df.sparkSession
    spark.dataSource.register(ArraySource)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, order).sortWithinPartitions(order).selectExpr(f"cast({order} as long) as id", "cast(vec as array<double>) as vec")
    rows.write.format("arrays").options(**options).mode(mode).save(path)
