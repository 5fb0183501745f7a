"""Benchmark decontamination with SimHash windows of the items' sizes.

For an item of n words every window of n words of a text has a SimHash over its five-word
shingles, from running sums of the shingles' bits. An index over the eight 8-bit blocks
of the items' fingerprints finds all items within ``radius`` bits: if two fingerprints
differ in at most r bits, one of the blocks differs in at most r // 8. Candidates are
verified by the exact weighted similarity of their shingles (sum of least counts over sum
of largest counts), which counts.

A text shorter than the item is one window. A window without any shingle of the item has similarity 0, so windows are formed around
shared shingles only; that loses nothing and leaves clean text at one hash and one table
look-up a word. With the default radius of 23 a block is off by two bits at most. Windows
at similarity 0.80 to 0.85 differ in 9.1 bits on average, 2.8 of standard deviation and 20
at most (4,420 edits of benchmark items; from 0.85 on 15 at most), so none was missed.

The items of a pass are broadcast; there are at most ``item_bytes`` of their text in one
(some 50 bytes of memory for each), and a larger benchmark takes several passes over the
documents.

Words are runs of letters, digits and marks, lower-cased. Defined cases: a null or empty
text, or a null or wordless item, matches nothing; a very long text's words are hashed in
parts; an item of fewer than five words is one shingle; of an item's windows of equal
similarity in a text the first is reported; repeated rows are reported each; null ids stay null; empty tables give an
empty result. Other columns are ignored by ``matches`` and carried along by ``clean``,
whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vicinia.llm.cdc import GEAR
from vicinia.llm.common import powers, splitmix

WIDTH = 5
PART = 1 << 20
#: Signs outside ASCII that part words.
SIGNS = re.compile("[\u00a0-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u00d7\u00f7\u2000-\u206f\u3000-\u303f\uff00-\uff0f]")
INSIDE = np.array([c >= 0x80 or chr(c).isalnum() for c in range(256)])
MIX = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(WIDTH)], dtype=np.uint64)


def lowered(text: str) -> str:
    low = text.lower()
    if len(low) != len(text):  # keep places: such letters stay as they are
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return low if low.isascii() else SIGNS.sub(" ", low)


def words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The text's bytes, its words' first and end bytes, and their hashes."""
    b = np.frombuffer(lowered(text).encode("utf-8", "surrogatepass"), dtype=np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], INSIDE[b], [False]))))
    begin, end = edge[::2], edge[1::2]
    hashes, at = np.empty(len(begin), np.uint64), 0
    while at < len(begin):  # words of at most PART bytes together, so that a very long text takes no more memory than a part
        first = int(begin[at])
        stop = max(at + 1, int(np.searchsorted(end, first + PART, side="right")))
        part = b[first : end[stop - 1]]
        if len(part) > PART:  # a word without end
            hashes[at] = xxhash.xxh64_intdigest(part.tobytes())
        else:
            up, down = powers(len(part) + 1)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(GEAR[part] * up[: len(part)], dtype=np.uint64)))
            own, ends = begin[at:stop] - first, end[at:stop] - first
            hashes[at:stop] = splitmix((sums[ends] - sums[own]) * down[own])
        at = stop
    return b, begin, end, hashes


def shingles(hashes: np.ndarray) -> np.ndarray:
    """One hash for each five words; one for all if they are fewer."""
    width = min(WIDTH, len(hashes))
    n = len(hashes) - width + 1
    if not width:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += hashes[k : k + n] * MIX[k]
    return splitmix(total)


def bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


class Items:
    """The benchmark items of a pass: their shingles, fingerprints and block indexes by size."""

    def __init__(self, ids: list, texts: list[str], radius: int):
        self.ids, self.radius = ids, radius
        hashes = [words(t)[3] for t in texts]
        self.sizes = [len(h) for h in hashes]
        self.shingles = [shingles(h) for h in hashes]
        self.counts = [Counter(s.tolist()) for s in self.shingles]
        self.of: dict[int, set[int]] = defaultdict(set)
        for k, s in enumerate(self.shingles):
            for h in s.tolist():
                self.of[h].add(k)
        self.short = {n for n in self.sizes if 0 < n < WIDTH}
        self.known = np.array(sorted(self.of), dtype=np.uint64)
        self.table = np.zeros(1 << 16, dtype=bool)
        self.table[self.known >> np.uint64(48)] = True
        self.prints = np.zeros(len(ids), dtype=np.uint64)
        for k, s in enumerate(self.shingles):
            if len(s):
                self.prints[k] = self.fingerprints(bits(s).sum(axis=0, dtype=np.int32)[None], len(s))[0]
        apart = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None, None] ^ self.prints.view(np.uint8).reshape(1, -1, 8))
        self.blocks = np.ascontiguousarray((apart <= radius // 8).transpose(2, 0, 1))  # by block and value: the items near enough there

    @staticmethod
    def fingerprints(ones: np.ndarray, n: int) -> np.ndarray:
        return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<u8").ravel()

    def near(self, prints: np.ndarray, items: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Which fingerprint lies within the radius of which of the items: block look-ups yield the pairs whose whole distance is taken."""
        byte, found = prints.view(np.uint8).reshape(-1, 8), np.zeros((len(prints), len(items)), dtype=bool)
        for k in range(8):
            found |= self.blocks[k, byte[:, k]][:, items]
        window, item = np.nonzero(found)
        close = np.bitwise_count(prints[window] ^ self.prints[items][item]) <= self.radius
        return window[close], item[close]

    def hits(self, s: np.ndarray) -> np.ndarray:
        """Places of the shingles that some item has."""
        at = np.flatnonzero(self.table[s >> np.uint64(48)])
        if not len(at) or not len(self.known):
            return at[:0]
        place = np.minimum(np.searchsorted(self.known, s[at]), len(self.known) - 1)
        return at[self.known[place] == s[at]]

    def matches(self, text: str, least: float) -> list[tuple[int, float, int, int]]:
        """(item, similarity, begin, end) of each item's best window, the earliest of equal ones; code points."""
        b, begin, end, hashes = words(text)
        out = []
        for width in {WIDTH, *self.short}:  # items shorter than a shingle have shingles of their own width
            if len(hashes) < width:
                continue
            s = shingles(hashes) if width == WIDTH else self.grams(hashes, width)
            by_size: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
            for at in self.hits(s).tolist():
                for item in self.of[int(s[at])]:
                    if min(self.sizes[item], WIDTH) == width:
                        by_size[self.sizes[item]][item].append(at)
            for size, found in by_size.items():
                n = size - width + 1  # shingles in a window
                items = sorted(found)
                if len(s) < n:  # a text shorter than the item is one window
                    for _, k in zip(*self.near(self.fingerprints(bits(s).sum(axis=0, dtype=np.int32)[None], len(s)), items), strict=True):
                        both = sum((Counter(s.tolist()) & self.counts[items[k]]).values())
                        if (likeness := both / (len(s) + n - both)) >= least:
                            out.append((items[k], likeness, 0, len(hashes)))
                    continue
                starts = np.unique(np.clip(np.concatenate([(np.array(found[i])[:, None] - np.arange(n)).ravel() for i in items]), 0, len(s) - n))
                lo = int(starts[0])
                for part in np.split(starts, np.flatnonzero(np.diff(starts) > 4 * n) + 1):  # far-off places apart
                    lo, hi = int(part[0]), int(part[-1]) + n
                    sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits(s[lo:hi]), axis=0, dtype=np.int32)))
                    for w, k in zip(*self.near(self.fingerprints(sums[part - lo + n] - sums[part - lo], n), items), strict=True):
                        at, item = int(part[w]), items[k]
                        both = sum((Counter(s[at : at + n].tolist()) & self.counts[item]).values())
                        if (likeness := both / (2 * n - both)) >= least:
                            out.append((item, likeness, at, at + size))
        best: dict[int, tuple[int, float, int, int]] = {}
        for m in sorted(out, key=lambda m: (-m[1], m[2])):
            best.setdefault(m[0], m)
        places = lambda x: int(np.count_nonzero((b[:x] & 0xC0) != 0x80))
        return [(i, v, places(begin[a]), places(end[z - 1])) for i, v, a, z in sorted(best.values())]

    @staticmethod
    def grams(hashes: np.ndarray, width: int) -> np.ndarray:
        n = len(hashes) - width + 1
        total = np.zeros(n, np.uint64)
        for k in range(width):
            total += hashes[k : k + n] * MIX[k]
        return splitmix(total)


def passes(items: DataFrame, item_col: str, text_col: str, radius: int, item_bytes: int) -> Iterator[Items]:
    """The items in blocks of at most ``item_bytes`` of text (a larger item alone)."""
    rows = items.where(F.col(text_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-2 * total // item_bytes))
    for k in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).toArrow().sort_by([("item", "ascending"), ("text", "ascending")])
        yield Items(own["item"].to_pylist(), own["text"].to_pylist(), radius)


def matches(docs: DataFrame, items: DataFrame, least: float = 0.8, radius: int = 23, item_bytes: int = 4 << 20, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and item with a window at ``least`` similarity: id, item, similarity, begin, end."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("item", items.schema[item_col].dataType), T.StructField("similarity", T.DoubleType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])
    out, kind = None, to_arrow_type(schema["item"].dataType)
    for block in passes(items, item_col, item_text_col, radius, item_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for b in batches:
                found = [(i, *m) for i, t in enumerate(b.column(1).to_pylist()) if t for m in known.matches(t, least)]
                own, item, likeness, begin, end = zip(*found, strict=True) if found else ([],) * 5
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own, pa.int32())), pa.array([known.ids[i] for i in item], kind), pa.array(likeness, pa.float64()), pa.array(begin, pa.int32()), pa.array(end, pa.int32())], ["id", "item", "similarity", "begin", "end"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, items: DataFrame, least: float = 0.8, radius: int = 23, item_bytes: int = 4 << 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents without those that hold a benchmark item."""
    at = docs.columns.index(text_col)
    for block in passes(items, item_col, item_text_col, radius, item_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not t or not shared.value.matches(t, least) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
