"""Importance resampling towards a target distribution, over hashed word n-grams.

Every run of 1 to ``width`` words is a feature; its bucket is the CRC-32 of its words,
joined by one space, modulo ``buckets``. With the bucket's counts in the raw table and in
the target table a document's weight is the sum of its features' log ratios (as whole
thousandths, with one added to each count), and the draw without replacement takes the
largest sums of weight and Gumbel noise, the noise a hash of seed and id.

CRCs are composed: each word's CRC is computed once, and the CRC of ``a + b`` is the CRC of
``a`` moved on by the length of ``b`` (a linear map over GF(2), by powers of two of bytes)
exclusive-or the CRC of ``b``. No n-gram is ever written out as a string.

Both tables are counted in one scan each (``buckets`` sums a task, then a sum a bucket; that
many rows reach the driver), and the documents are scanned once more for their weights. The
draw ranks rows by ranges, so nothing but a count a partition is gathered.

Defined cases: words are runs of digits, letters (A-Z lower-cased) and non-ASCII characters;
a null or wordless text has no features, weight 0 and a score of its noise alone; a very
long text is worked on whole, a quarter of a megabyte at a time; ties go to the smaller id, null ids
last, and a null id's noise is that of the empty text; rows that repeat an id are rows of
their own; an empty raw table gives an empty result, an empty target one whose counts are 0;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinia.llm.common import Workspace, numbered, utf8_rows

#: Letters to lower case, what parts words to blanks.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
POLYNOMIAL = 0xEDB88320  # CRC-32, bits reversed
BLOCK = 1 << 18  # bytes whose words are held as objects at once


@cache
def _shift(power: int) -> np.ndarray:
    """Moving a CRC on by 2**power zero bytes, as four tables of its bytes' images."""
    if power:
        half = _shift(power - 1)
        columns = _moved(half, _moved(half, np.left_shift(np.uint32(1), np.arange(32, dtype=np.uint32))))
    else:
        c = np.left_shift(np.uint32(1), np.arange(32, dtype=np.uint32))
        for _ in range(8):
            c = (c >> np.uint32(1)) ^ np.where(c & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
        columns = c
    bits = np.arange(256)[:, None] >> np.arange(8) & 1
    return np.stack([np.bitwise_xor.reduce(np.where(bits, columns[8 * k : 8 * k + 8], np.uint32(0)), axis=1) for k in range(4)]).astype(np.uint32)


def _moved(tables: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    out = tables[0][crcs & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ tables[k][crcs >> np.uint32(8 * k) & np.uint32(255)]
    return out


def combined(left: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of joined strings, by the CRCs of both parts and the right part's length in bytes."""
    out, power = left.astype(np.uint32), 0
    while (lengths >> power).any():
        at = np.flatnonzero(lengths >> power & 1)
        out[at] = _moved(_shift(power), out[at])
        power += 1
    return out ^ right


def _blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, about ``BLOCK`` bytes at a time."""
    plain, at = text.translate(TABLE), 0
    while at < len(plain):
        end = plain.find(b" ", at + BLOCK)
        end = len(plain) if end < 0 else end
        if words := plain[at:end].split():
            yield words
        at = end


def features(text: bytes, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, CRCs of all features that end in them) of a text, a block of words at a time."""
    held_crc, held_len = np.empty(0, np.uint32), np.empty(0, np.int64)
    for block in _blocks(text):
        own = len(block)
        crc = np.concatenate((held_crc, np.fromiter(map(crc32, block), np.uint32, own)))
        out, runs, before = [crc[len(held_crc) :]], crc, len(held_crc)
        if width > 1:
            length = np.concatenate((held_len, np.fromiter(map(len, block), np.int64, own)))
            spaced = combined(np.full(len(crc), crc32(b" "), np.uint32), crc, length)  # of " word"
        for n in range(2, width + 1):  # runs[i]: the CRC of the n - 1 words from i on
            runs = combined(runs[: len(crc) - n + 1], spaced[n - 1 :], length[n - 1 :] + 1)
            out.append(runs[max(0, before - n + 1) :])
        yield own, np.concatenate(out)
        keep = max(0, len(crc) - width + 1)
        held_crc, held_len = crc[keep:], length[keep:] if width > 1 else held_len


def bucket_counts(df: DataFrame, width: int, buckets: int, text_col: str = "text") -> np.ndarray:
    """How many features of the table's texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for b in batches:
            for t in utf8_rows(b.column(0)):
                for _, crcs in features(t, width):
                    held += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], ["bucket", "n"])

    rows = df.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row for each bucket
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's log ratio of smoothed shares, target to raw, in whole thousandths (floor)."""
    buckets, S, T_ = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (S + buckets) / ((s + 1.0) * (T_ + buckets)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def noise(seed: int, key: int | str | None) -> int:
    """Gumbel noise in whole thousandths (floor), from the first 32 bits of a hash of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def resample(df: DataFrame, target: DataFrame, width: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Return id, ``n_features``, ``weight``, ``score`` and ``rank`` of every row; the ``percent`` of 100 drawn rows of at least ``least_words`` words are ranked from 1, the others have null."""
    ws = Workspace(df.sparkSession, "resampling")
    gain = gains(bucket_counts(df, width, buckets, text_col), bucket_counts(target, width, buckets, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, sizes, weights = [], [], []
            for t in utf8_rows(b.column(1)):
                n = size = weight = 0
                for own, crcs in features(t, width):
                    n, size, weight = n + own, size + len(crcs), weight + int(gain[crcs % np.uint32(buckets)].sum())
                words.append(n)
                sizes.append(size)
                weights.append(weight)
            score = [w + noise(seed, k) for w, k in zip(weights, b.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (words, sizes, weights, score))], ["id", "n_words", "n_features", "weight", "score"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    longs = [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight", "score")]
    scored = rows.mapInArrow(run, T.StructType([rows.schema["id"], *longs])).withColumn("short", F.col("n_words") < least_words)
    scored = ws.save(scored, "scores")  # a range sort reads its rows twice
    placed, written = numbered(ws, scored, ["short", F.desc("score"), F.asc_nulls_last("id")], "scored")
    drawn = written.where(~F.col("short")).count() * percent // 100
    return placed.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(F.col("pos") < drawn, F.col("pos") + 1).alias("rank"))
