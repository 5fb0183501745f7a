"""Document fingerprints from content-defined chunks.

A text is normalised (A-Z lower-cased, white space runs to one space) and cut where a
gear hash of its last 32 bytes falls under a mask: a hard mask up to the normal chunk
size, an easy one after it, with a least and a largest size. Boundaries depend on nearby
bytes only, so an edit moves the chunks around it and no others. The fingerprint is the
set of chunk digests with their lengths, as sorted 20-digit groups (16 hex digits of the
64-bit digest, 4 of the length). ``containment`` is the share of a fingerprint's length whose
chunks the other one has, from 0 to 1.

Defined cases: a null text is empty; an empty text has the empty fingerprint, which is
contained in the empty one (1) and in no other (0); repeated rows are documents of their
own, in order of id and then text hash (equal ones have the same fields in either order); null ids sort first; a lone document is its own
successor; an empty table gives an empty result. Other columns are ignored, whatever
their names; a very long text takes memory in step with its length in one task. Ids are
integers.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinia.llm.common import partitions, splitmix

LEAST, NORMAL, LARGEST = 24, 64, 256
HARD, EASY = np.uint32(1 << 25), np.uint32(1 << 27)  # one in 128, one in 32
GEAR = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
GEAR32 = (GEAR >> np.uint64(32)).astype(np.uint32)
Chunks = tuple[np.ndarray, np.ndarray]  # sorted digests and their chunks' lengths


def boundaries(b: np.ndarray) -> list[int]:
    """Ends of the chunks of a byte array."""
    h = GEAR32[b]
    for s in (1, 2, 4, 8, 16):  # h[i] is then the sum of gear[b[i - j]] << j for j < 2 s
        h[s:] += h[:-s] << np.uint32(s)
    easy = np.flatnonzero(h < EASY) + 1
    hard = easy[h[easy - 1] < HARD].tolist() + [1 << 62]
    easy = easy.tolist() + [1 << 62]
    out, at, n = [], 0, len(b)
    while n - at > LEAST:
        cut = hard[bisect_left(hard, at + LEAST)]
        if cut >= at + NORMAL:
            cut = min(easy[bisect_left(easy, at + NORMAL)], at + LARGEST)
        if cut >= n:
            break
        out.append(cut)
        at = cut
    if n > at:
        out.append(n)
    return out


def chunks(text: str) -> Chunks:
    """The set of a text's chunks."""
    b = b" ".join(text.encode("utf-8", "surrogatepass").lower().split())
    if not b:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    ends = boundaries(np.frombuffer(b, dtype=np.uint8))
    starts = [0, *ends[:-1]]
    digest, at = np.unique(np.array([xxhash.xxh3_64_intdigest(b[i:j]) for i, j in zip(starts, ends, strict=True)], dtype=np.uint64), return_index=True)
    return digest, (np.array(ends) - starts)[at]


def fingerprint(found: Chunks) -> str:
    rows = np.zeros((len(found[0]), 10), dtype=np.uint8)
    rows[:, :8] = found[0].astype(">u8").view(np.uint8).reshape(-1, 8)
    rows[:, 8:] = found[1].astype(">u2").view(np.uint8).reshape(-1, 2)
    return rows.tobytes().hex()


def containment(of: Chunks, within: Chunks) -> float:
    if not len(of[0]):
        return float(not len(within[0]))
    if not len(within[0]):
        return 0.0
    at = np.minimum(np.searchsorted(within[0], of[0]), len(within[0]) - 1)
    return float(of[1][within[0][at] == of[0]].sum() / of[1].sum())


def with_next(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, int]:
    """Deal documents in order of id to partitions in which each is followed by its successor.

    Texts are shuffled once. Ranges of ids come from quantiles; the first document of a
    range is also sent to the range before it (the table's first one to the last range),
    with ``late`` set: there it is only a successor.
    """
    from pyspark.ml.feature import Bucketizer

    n = partitions(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    place = F.coalesce(F.col("id").cast("double"), F.lit(float("-inf")))
    cuts = sorted(set(rows.select(place.alias("x")).where("x > double('-infinity')").approxQuantile("x", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    dealt = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="place", outputCol="bucket").transform(rows.withColumn("place", place)) if cuts else rows.withColumn("bucket", F.lit(0.0))
    dealt = dealt.select("id", "text", F.col("bucket").cast("int").alias("bucket"))
    # one row a range goes to the driver
    first = dealt.groupBy("bucket").agg(F.min("id").alias("id"), F.bool_or(F.col("id").isNull()).alias("none")).toArrow().sort_by("bucket").to_pylist()
    firsts = [(None if r["none"] else r["id"], first[k - 1]["bucket"], k == 0) for k, r in enumerate(first)]
    extra = df.sparkSession.createDataFrame(firsts, T.StructType([T.StructField("first_id", rows.schema["id"].dataType), T.StructField("before", T.IntegerType()), T.StructField("wraps", T.BooleanType())]))
    own = F.struct("bucket", F.lit(0).alias("late"))
    again = F.struct(F.col("before").alias("bucket"), F.when(F.col("wraps"), 2).otherwise(1).alias("late"))
    both = dealt.join(F.broadcast(extra), F.col("id").eqNullSafe(F.col("first_id")), "left")
    spread = both.select("id", "text", F.inline(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, again))))
    order = ["bucket", "late", F.col("id").asc_nulls_first(), F.xxhash64("text")]
    return spread.repartitionById(n, F.col("bucket")).sortWithinPartitions(*order), n


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def fingerprints(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edited text, with the containments of its own in the edited and in the next one's."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its successor
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for key, text, bucket, late in zip(*(c.to_pylist() for c in b.columns), strict=True):
                now = (key, text, bucket, chunks(text))
                if held is not None and held[2] == bucket:
                    changed = edited(held[1], text)
                    other = chunks(changed)
                    row = (held[0], len(held[1]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(held[3]), fingerprint(other), containment(held[3], other), containment(held[3], now[3]), len(held[3][0]))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                held = None if late else now
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds(b), strict=True)], names)

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_chunks"]
    kinds = lambda b: [b.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    rows, _ = with_next(df, text_col, id_col)
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in names[2:5]), *(T.StructField(c, T.DoubleType()) for c in names[5:7]), T.StructField("n_chunks", T.LongType())])
    return rows.mapInArrow(pairs, schema).withColumnRenamed("id", id_col)
