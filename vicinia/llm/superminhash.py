"""Near copies by SuperMinHash signatures, banding, verification and union-find grouping.

A signature has ``SIZE`` places. An element gives each place a value by walking a random
permutation of the places, its own: at step j the j-th place of its permutation gets j plus
a random fraction, so an element's values are spread evenly over the places, and signatures
vary less than those of independent hashes. Place by place the smallest value over a set
stays; two sets agree in a place with the probability of their similarity. Steps stop for a
set as soon as all its places are below the next step's values, after a few steps for all
but the smallest sets. Values are whole numbers (step << 32 | fraction), and all sets of a
batch walk together.

``BANDS`` keys of ``ROWS`` places each bring candidates (two sets at 0.85 share none with
probability (1 - 0.85^5)^32 = 7e-9, less above); equal sets collapse before by a 128-bit
digest. Every link is confirmed on the whole sets, as whole numbers, and ``families`` joins
links to components without all pairs of a key.

Defined cases: words are what blanks part (0x20, 0x09 to 0x0D), A-Z lower-cased; a text of
fewer than ``width`` words is one shingle; without words or text a set is empty and linked
with nothing; a very long text's set is taken whole, its walk in blocks; rows that repeat
an id are rows of their own, though their component and ``kept`` are those of the id's
texts; a null id names a component only if none of its rows has an id; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinia.llm.common import BASE, WordHashes, Workspace, phrase_hashes, splitmix, utf8_rows
from vicinia.llm.families import banded, families

BANDS, ROWS = 32, 5
SIZE = BANDS * ROWS
BLOCK = 1 << 16  # elements that walk at once


def shingles(text: bytes, width: int, hashes: WordHashes) -> np.ndarray:
    """The sorted hashes of a text's different word shingles."""
    h = g = hashes.of(text.lower().split())  # of bytes: exactly A-Z, and exactly the blanks above
    for n in range(2, min(width, len(h)) + 1):
        g = phrase_hashes(h, n, g)
    return np.unique(g)


def signatures(elements: np.ndarray, of: np.ndarray, sets: int) -> np.ndarray:
    """SuperMinHash signatures (sets, SIZE) of sets of hashes; ``of`` names each element's set."""
    out = np.full((sets, SIZE), 2**64 - 1, np.uint64)
    flat = out.reshape(-1)
    for at in range(0, len(elements), BLOCK):
        own, x = of[at : at + BLOCK], elements[at : at + BLOCK]
        order = np.tile(np.arange(SIZE, dtype=np.int16), (len(x), 1))
        for j in range(SIZE):
            row, u = np.arange(len(x)), splitmix(x + np.uint64(BASE * (j + 1) & 2**64 - 1))
            pick = j + ((u >> np.uint64(32)) * np.uint64(SIZE - j) >> np.uint64(32)).astype(np.int64)
            place = order[row, pick]
            order[row, pick] = order[:, j]
            np.minimum.at(flat, own * SIZE + place, u & np.uint64(2**32 - 1) | np.uint64(j << 32))
            names, back = np.unique(own, return_inverse=True)
            open_ = (out[names].max(axis=1) >= np.uint64(j + 1 << 32))[back]
            if not open_.all():
                own, x, order = own[open_], x[open_], order[open_]
            if not len(x):
                break
    return out


def _tagged(docs: DataFrame, width: int) -> DataFrame:
    """docs (id, text, place) with n, digest and keys of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            if not b.num_rows:
                continue
            sets = [shingles(t, width, hashes) for t in utf8_rows(b.column(1))]
            sizes = np.array([len(x) for x in sets])
            keys = banded(signatures(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), len(sets)), ROWS)
            ends = np.concatenate(([0], np.cumsum(np.where(sizes > 0, BANDS, 0)))).astype(np.int32)
            own = [pa.array(sizes), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(keys[sizes > 0].ravel()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *own], ["id", "text", "place", "n", "digest", "keys"])

    more = [T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def near_duplicates(df: DataFrame, percent: int = 85, width: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Return id, ``n_shingles``, ``component_id`` (the smallest id reachable over links of ``percent`` of 100 or more) and ``kept`` (id = component_id) of every row."""
    ws = Workspace(df.sparkSession, "superminhash")
    tagged = ws.save(_tagged(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("place")), width), "tagged")
    nodes = ws.save(tagged.where("n > 0").groupBy("digest").agg(F.min("place").alias("node"), F.min("n").alias("n"), F.first("keys").alias("keys"), F.min("id").alias("least")), "nodes")
    held = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = ws.save(held.join(held.groupBy("key").agg(F.count("*").alias("many")).where("many > 1").hint("merge"), "key"), "shared")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, width, hashes).tobytes() for t in utf8_rows(b.column(1))], pa.binary())], ["node", "grams"])

    texts = tagged.select(F.col("place").alias("node"), "text").join(shared.select("node").distinct().hint("merge"), "node", "left_semi")
    sets = ws.save(texts.mapInArrow(grams, "node long, grams binary"), "sets")
    linked = families(ws, shared, sets, percent)
    rooted = ws.save(nodes.select("digest", "node", "least").join(linked.hint("merge"), "node", "left").select("digest", "least", F.coalesce("root", "node").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(named.hint("merge"), "root").select("digest", "component_id")
    rows = tagged.select("id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(of.hint("merge"), "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
