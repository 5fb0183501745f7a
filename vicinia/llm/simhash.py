"""SimHash near-duplicates by anchor-point covering.

Equal fingerprints collapse first. A fingerprint is then cut into blocks of 2^r - 1
bits; the codewords of the Hamming code of that length are the anchors. The code is
perfect: every block value has exactly one anchor within one bit (covering radius 1).
If two fingerprints differ in at most d bits, then in one of m blocks they differ in at
most e = d // m bits; the first one's home anchor there is then within 1 + e bits of the
second one. So each fingerprint goes to its home anchor in every block and is replicated
to every anchor within 1 + e, and only fingerprints that meet at an anchor are compared,
by their whole distance. No link is lost and no cap is needed. With 31-bit blocks and
d = 3 that is 2 homes and 32 replicas each, over 2 * 2^26 anchors.

Links join fingerprints, not documents: copies never expand into pairs. Components come
from alternating large and small stars over written tables. Every join is a merge join, also
where one side is small: a broadcast is built in the driver, and rounds of them add up there.

Defined cases: a null or wordless text has fingerprint zero and links like any other; a
very long text is hashed whole, in blocks of shingles; a bit that is set in just half of
the hashes is 0; repeated rows are rows of their own; of rows with the least id of a
component the first read stays; a null id never becomes a component's id unless all
ids of the component are null; an empty table gives an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinia.llm.common import Workspace, utf8_rows

SEED = 42


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; words are lower-cased A-Z."""
    words = text.lower().split()  # of bytes: exactly A-Z, and exactly 0x20 and 0x09-0x0D
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words])
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    starts, stops = [0, *ends[: n - 1].tolist()], (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):  # a very long text takes no more memory than a block
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536], strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def of_hashes(hashes: np.ndarray) -> int:
    """64-bit SimHash of a set of shingle hashes (unsigned 64-bit); 0 of an empty one."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        h = hashes[at : at + 65536].astype("<u8", copy=False)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 3) -> DataFrame:
    """Return id and ``fp`` (the fingerprint's 64 bits as a long) of every row."""

    def blocks(batches):
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in utf8_rows(b.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(blocks, T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("fp", T.LongType())]))


def _syndrome(word: Column, r: int) -> Column:
    """Which bit (from 1) to flip to reach the home anchor; 0: none."""
    out = F.lit(0)
    for j in range(r):
        mask = sum(1 << (i - 1) for i in range(1, 2**r) if i >> j & 1)
        out = out + (F.bit_count(word.bitwiseAND(F.lit(mask))) % 2) * (1 << j)
    return out.cast("int")


def _patterns(r: int, radius: int) -> list[list[int]]:
    """For each syndrome: the flips of at most ``radius`` bits that lead to an anchor."""
    out: list[list[int]] = [[] for _ in range(2**r)]
    for weight in range(radius + 1):
        for bits in combinations(range(1, 2**r), weight):
            s = 0
            for b in bits:
                s ^= b
            out[s].append(sum(1 << (b - 1) for b in bits))
    return out


def links(fps: DataFrame, distance: int = 3, r: int = 5) -> DataFrame:
    """All pairs ``a < b`` of distinct fingerprints (column ``fp``) at most ``distance`` bits apart."""
    size = 2**r - 1
    blocks = 64 // size
    patterns = _patterns(r, 1 + distance // blocks)
    homes, replicas = [], []

    def anchor(block: int, word: Column, flip: Column) -> Column:
        return F.struct(F.lit(block).alias("block"), word.bitwiseXOR(flip).alias("anchor"))

    def replica(block: int, word: Column) -> Callable[[Column], Column]:
        return lambda flip: anchor(block, word, flip)

    for k in range(blocks):
        shift = k * (64 - size) // max(1, blocks - 1)  # spread over the word; the bits between blocks need no block
        word = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(2**size - 1))
        s = _syndrome(word, r)
        flips = F.element_at(F.array(*[F.array(*[F.lit(p).cast("long") for p in ps]) for ps in patterns]), s + 1)
        homes.append(anchor(k, word, flips[0]))  # the pattern of least weight leads home
        replicas.append(F.transform(flips, replica(k, word)))
    left = fps.select(F.col("fp").alias("a"), F.inline(F.array(*homes)))
    right = fps.select(F.col("fp").alias("b"), F.inline(F.flatten(F.array(*replicas))))
    met = left.join(right.hint("merge"), ["block", "anchor"]).where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return met.select("a", "b").distinct()


def components(ws: Workspace, edges: DataFrame, name: str = "stars") -> DataFrame:
    """Return ``node`` and ``root`` (the smallest node reachable) of every node that an edge (a, b) touches."""

    def pulled(pairs: DataFrame) -> DataFrame:
        """(u, v) with the smallest of u and all its v."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs.join(least.hint("merge"), "u")

    now = ws.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), f"{name}-0")
    mark, step = None, 0
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = pulled(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = pulled(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        step += 1
        now = ws.save(small, f"{name}-{step}")
        ws.drop(f"{name}-{step - 1}")
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def _placed(ws: Workspace, rows: DataFrame, distance: int) -> DataFrame:
    """Return ``fp``, ``root`` and component_id of every fingerprint of the rows (id, fp)."""
    fps = ws.save(rows.groupBy("fp").agg(F.min("id").alias("least")), "fps")
    stars = components(ws, links(fps, distance))
    rooted = fps.join(stars.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(named.hint("merge"), "root").select("fp", "root", "component_id")


def near_duplicates(df: DataFrame, distance: int = 3, width: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Return id, ``fp`` and component_id (the smallest id reachable over links of at most ``distance`` bits) of every row."""
    ws = Workspace(df.sparkSession, "simhash")
    rows = ws.save(fingerprints(df, text_col, id_col, width), "rows")
    of = _placed(ws, rows, distance)
    return rows.join(of.hint("merge"), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def representatives(df: DataFrame, distance: int = 3, width: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id, without an id only where no row of the component has one.

    The rows are written once with a number and their fingerprint, so rows that repeat an
    id or have none stay apart.
    """
    ws = Workspace(df.sparkSession, "representatives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in utf8_rows(b.column(2))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(fp.view(np.int64)), b.column(3)], ["row", "id", "fp", "place"])

    own = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("place"))
    tagged = ws.save(own.mapInArrow(run, T.StructType([own.schema["row"], own.schema["id"], T.StructField("fp", T.LongType()), T.StructField("place", T.LongType())])), "tagged")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "place"))
    keep = tagged.select("id", "fp", "place").join(_placed(ws, tagged.select("id", "fp"), distance).hint("merge"), "fp").groupBy("root").agg(least.alias("first")).select(F.col("first.place").alias("place"))
    return tagged.join(ws.save(keep, "keep").hint("merge"), "place", "left_semi").select(*[F.col("row")[c].alias(c) for c in df.columns])
