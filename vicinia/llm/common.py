"""What the operators of this package share: row numbering, folds, texts as bytes."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinia.sources.workspace import Workspace

def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(ws: Workspace, df: DataFrame, order: list[str | Column], name: str) -> tuple[DataFrame, DataFrame]:
    """Number all rows from 0 in the given order without gathering them anywhere.

    The rows are dealt by range, sorted in their partitions and written; only one
    count a partition goes to the driver. Returns the rows with ``pos`` (long) and
    the written rows themselves (for further counts). A range may cut a run of equal
    leading keys, so one hot key doesn't fill one task; put a tie-breaker last.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.repartitionByRange(partitions(ws.spark), *order).sortWithinPartitions(*order)
    mid = F.monotonically_increasing_id()
    rows = ws.save(dealt.select("*", F.shiftrightunsigned(mid, 33).cast("int").alias("_part"), mid.bitwiseAND(F.lit((1 << 33) - 1)).alias("_local")), name)
    counts = rows.groupBy("_part").count().toArrow().sort_by("_part")  # a row for each partition
    n = counts["count"].to_numpy()
    starts = ws.spark.createDataFrame(pa.table({"_part": counts["_part"], "_start": n.cumsum() - n}))
    out = rows.join(F.broadcast(starts), "_part")  # bounded by the number of partitions
    return out.select(*df.columns, (F.col("_start") + F.col("_local")).alias("pos")), rows


def utf8_rows(texts: pa.Array) -> Iterator[bytes]:
    """UTF-8 of each text of an Arrow column, one at a time; null is empty."""
    return (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts)


def one_thread() -> None:
    """A worker is one of many on its machine: libraries shall not start a thread a core."""
    for k in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS", "RAYON_NUM_THREADS"):
        os.environ.setdefault(k, "1")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def crc_fold(id_col: str | Column) -> Column:
    """The fold of a row: crc32 of its id as text, modulo 3; fold 1 is held out. A null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(3))


def splitmix(x: np.ndarray) -> np.ndarray:
    """Mix 64-bit words so that every bit of the result depends on every bit of the input (SplitMix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least; a worker keeps them, so callers take long texts in parts."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


class WordHashes(dict):
    """A 64-bit hash of each word, remembered; 0 of the separator."""

    def __init__(self, separator: bytes | None = None, most: int = 1 << 18):
        super().__init__()
        self.separator, self.most = separator, most

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.most:
            self.clear()
        self[word] = out = 0 if word == self.separator else xxhash.xxh64_intdigest(word) | 1
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def phrase_hashes(h: np.ndarray, n: int, before: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the phrases of n words that begin at each place, from the words' hashes and those of n - 1 words; 0 across a separator."""
    before = h if before is None else before
    ahead = h[n - 1 :]
    out = splitmix(before[: len(ahead)] * np.uint64(BASE) + ahead + np.uint64(n)) | np.uint64(1)
    out[(before[: len(ahead)] == 0) | (ahead == 0)] = 0
    return out
