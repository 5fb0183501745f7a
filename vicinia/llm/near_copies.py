"""SimHash near copies by anchor covering, completed to an exact five-word similarity.

Two texts are near copies if their sets of word shingles have a Jaccard similarity of
``percent`` (80) of 100 or more. Every pair that links is verified by its whole sets before,
so no link is wrong.

Texts with equal sets (by a 128-bit digest) collapse first. The others get the SimHash of
their sets, and op2's anchor-point covering (``simhash.links``) finds all pairs of
fingerprints that differ in at most ``DISTANCE`` bits; those that pass the exact check are
joined. Of texts with one fingerprint the first is held against each other one, and stands
for them in pairs of fingerprints.

SimHash bits can't find all near copies: a pair at 0.8 differs in about 10 of 64 bits,
and anchor covering can't carry the 24 that would have to be covered. So the texts that
aren't joined yet get further candidates from min-wise samples, ``BANDS`` keys of ``ROWS``
least hashes each: a pair at 0.8 shares no key with probability (1 - 0.8^5)^24 = 7e-5, and
less above. ``families`` turns both into groups.

Defined cases: words are lower-cased runs of letters and digits, and in a text without any
what blanks part; a text of fewer than ``width`` words is one shingle; null and blank
texts are equal to each other and to nothing else; a very long text is hashed whole, its
samples taken in blocks; rows that repeat an id or have none stay apart, and of rows with
one id the one with the smallest hash of its text stays; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinia.llm.common import Workspace, utf8_rows
from vicinia.llm.families import banded, families
from vicinia.llm.simhash import SEED, links, of_hashes

#: Bits that fingerprints may differ in to meet by anchor covering.
DISTANCE = 3
BANDS, ROWS = 24, 5
WORD = re.compile(r"[^\W_]+")
_RNG = np.random.default_rng(SEED)
FACTORS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """The sorted hashes of a text's different word shingles."""
    low = text.decode("utf-8", "replace").lower()
    words = [w.encode() for w in WORD.findall(low) or low.split()]
    if not words:
        return np.empty(0, np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    starts, stops = [0, *ends[: n - 1].tolist()], (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64))


def bands(grams: np.ndarray) -> list[int]:
    """The keys of a set of shingles; none of an empty one."""
    if not len(grams):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(grams), 4096):  # a very long text takes no more memory than a block
        np.minimum(least, (grams[None, at : at + 4096] * FACTORS[:, None] + SHIFTS[:, None]).min(axis=1), out=least)
    return banded(least[None], ROWS)[0].tolist()


def _covered(ws: Workspace, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of the nodes (node, n, fp) that SimHash takes for near copies: equal fingerprints with their first node, others by anchor covering."""
    own = nodes.where("n > 0").select("node", "fp")
    first = ws.save(own.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    same = own.join(first.hint("merge"), "fp").where(F.col("node") != F.col("first")).select(F.col("first").alias("a"), F.col("node").alias("b"))
    left, right = (first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node")) for c in "ab")
    met = ws.save(links(first.select("fp"), DISTANCE), "met")
    other = met.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))
    return ws.save(same.union(other), "covered")


def representatives(df: DataFrame, percent: int = 80, width: int = 5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each component of near copies, with all its columns: that of the smallest id, without an id only where no row of the component has one."""
    ws = Workspace(df.sparkSession, "near-copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digest, size, fp, keys = [], [], [], []
            for t in utf8_rows(b.column(2)):
                g = shingles(t, width)
                digest.append(xxhash.xxh3_128_digest(g.tobytes()))
                size.append(len(g))
                fp.append(of_hashes(g))
                keys.append(bands(g))
            own = [pa.array(digest, pa.binary()), pa.array(size, pa.int32()), pa.array(np.array(fp, dtype=np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *own], ["row", "id", "text", "place", "digest", "n", "fp", "keys"])

    own = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("place"))
    fields = [T.StructField("digest", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    tagged = ws.save(own.mapInArrow(run, T.StructType([*own.schema.fields, *fields])), "tagged")
    nodes = ws.save(tagged.groupBy("digest").agg(F.min("place").alias("node"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.first("keys").alias("keys")), "nodes")
    covered = _covered(ws, nodes)
    held = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = ws.save(held.join(held.groupBy("key").agg(F.count("*").alias("many")).where("many > 1").hint("merge"), "key"), "shared")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, width).tobytes() for t in utf8_rows(b.column(1))], pa.binary())], ["node", "grams"])

    asked = shared.select("node").union(covered.select("a")).union(covered.select("b")).distinct()
    texts = tagged.select(F.col("place").alias("node"), "text").join(asked.hint("merge"), "node", "left_semi")
    sets = ws.save(texts.mapInArrow(grams, "node long, grams binary"), "sets")
    linked = families(ws, shared, sets, percent, covered)
    of = nodes.select("digest", "node").join(linked.hint("merge"), "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    rows = tagged.select("id", "place", F.xxhash64("text").alias("hash"), "digest").join(of.hint("merge"), "digest")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash", "place"))
    keep = rows.groupBy("root").agg(first.alias("first")).select(F.col("first.place").alias("place"))
    return tagged.join(ws.save(keep, "keep").hint("merge"), "place", "left_semi").select(*[F.col("row")[c].alias(c) for c in df.columns])
