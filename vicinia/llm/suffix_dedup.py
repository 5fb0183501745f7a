"""Exact substring dedup: prefix doubling at a synchronised sample of positions.

A byte goes if a string of ``least`` bytes over it also starts earlier (smaller id, or
the same document, earlier place). Ranking every position of the corpus would sort a row a
byte in each round. Instead the ranked positions are those that texts choose alike: of
the ``gram``-byte grams within each window of ``least`` bytes, the one of least hash is
the window's anchor. Equal windows have their anchors at the same place, and an anchor
stands for a run of neighbouring windows.

Each round range-sorts rank pairs and ranks anew, until a position is unique or the
string is past the threshold:

1. The pair is (gram, bytes of all the anchor's windows). A gram that occurs once is
   unique and drops out with all its windows. An anchor whose pair occurs earlier is a
   copy: all its windows go. The first anchors of each pair go on where their gram has
   several pairs: their windows are alike in part.
2. Then the bytes around those come along (one join with the texts), and the string that
   is ranked grows on both sides of the anchor: twice the gram, nearly the threshold, the
   whole window (64, 95 and 100 bytes). The windows that share such a string are a
   block. The pair is (rank so far with the longer string, bytes of the block's windows),
   with the same three outcomes for the block. In the last round a block is a window.
3. Spans are merged by document and cut out (the second and last join with the texts).

Ranks are 64-bit names of the bytes, and a string of a later round is named under its
rank before; two unequal pairs are taken as equal with a chance of 2^-128 for bytes that
aren't made for it. A range may begin or end within a gram or a pair, so hot ones don't
fill one task: a range tells its first pair and its last one, and these are settled
together, two rows a range. Texts cross the joins compressed.

Defined cases: a null text is empty; texts of fewer than ``least`` bytes lose nothing; a
very long text is taken in parts that overlap; null ids rank first, and rows that repeat
an id rank by text and then by a number given once (that takes a written copy of the
table), so of ties the first in this order stays; an empty table gives an empty result.
Other columns are ignored, whatever their names. Ids are integers.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinia.llm.cdc import GEAR
from vicinia.llm.common import Workspace, numbered, partitions, powers, splitmix, utf8_rows

#: Bytes of a text looked at together; longer texts are taken in overlapping parts.
PART = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of texts or of anchors' windows that leave a worker together, one text's at least.
TOGETHER = 1 << 20
COPY, FIRST, EDGE, EDGE_SEVERAL, SEEN = range(5)


def running(b: np.ndarray) -> np.ndarray:
    """Sums whose differences name substrings: (sums[j] - sums[i]) * down[i]."""
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(GEAR[b] * powers(len(b) + 1)[0][: len(b)], dtype=np.uint64)))


def names(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return splitmix((sums[end] - sums[begin]) * powers(len(sums))[1][begin])


def anchors(b: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """Names of gram and windows, place, and first and last window of each anchor."""
    n, w = len(b), least - gram + 1
    if n < least:
        return (*(np.empty(0, np.uint64),) * 2, *(np.empty(0, np.int64),) * 3)
    sums = running(b)
    at = np.arange(n - gram + 1)
    name = names(sums, at, at + gram)
    least_of = name >> np.uint64(24) << np.uint64(24) | at.astype(np.uint64)  # ties: the leftmost
    step = 1
    while 2 * step <= w:  # the least of 1, 2, 4 ... grams on from each place
        least_of, step = np.minimum(least_of[:-step], least_of[step:]), 2 * step
    windows = n - least + 1
    anchor = (np.minimum(least_of[:windows], least_of[w - step : w - step + windows]) & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    last = np.concatenate((first[1:] - 1, [windows - 1]))
    place = anchor[first]
    whole = splitmix(names(sums, first, last + least) + ((place - first) * 256 + last - first).astype(np.uint64) * ODD)
    return name[place], whole, place, first, last


def anchor_rows(least: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, found, size = b.column(0).to_numpy(), [], 0
            for key, text in zip(keys.tolist(), utf8_rows(b.column(1)), strict=True):
                whole = np.frombuffer(text, dtype=np.uint8)
                for at in range(0, max(1, len(whole) - least + 1), PART):
                    g, w, place, first, last = anchors(whole[at : at + PART + least - 1], least, gram)
                    found.append((g, w, np.full(len(g), key), (place + at) << 16 | (place - first) << 8 | (place - last)))
                    size += len(g)
                if size > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in zip(*found, strict=True)], ["gram", "whole", "key", "at"])
                    found, size = [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in zip(*found, strict=True)], ["gram", "whole", "key", "at"])

    return run


def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rank a range of rows sorted by (gram, whole, key, at), in which columns after these go along.

    Of rows with equal pairs (gram, whole) all but the first are copies. The first ones go
    on where their gram has several pairs; else they are unique and drop out. A range may
    begin and end anywhere, so two rows of it, the first one and the first one of the
    last pair, are edges that ``settled`` decides. Nothing but single rows is held.
    """
    a = z = pending = gram = whole = None
    several = a_open = a_several = z_is_a = False

    def out(rows: pa.RecordBatch, kind: int) -> pa.RecordBatch:
        columns = rows.columns[:4] + [pa.nulls(rows.num_rows, c.type) if kind == COPY else c for c in rows.columns[4:]]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(rows.num_rows, kind, np.int8))], [*rows.schema.names, "kind"])

    for b in batches:
        if not b.num_rows:
            continue
        grams, wholes = b.column(0).to_numpy(), b.column(1).to_numpy()
        start = a is None
        new_gram = np.concatenate(([start or grams[0] != gram], grams[1:] != grams[:-1]))
        new_pair = new_gram | np.concatenate(([start or wholes[0] != whole], wholes[1:] != wholes[:-1]))
        of = np.cumsum(new_gram)  # 0: the gram that goes on from the batch before
        last = int(of[-1])
        pairs = np.bincount(of, new_pair, minlength=last + 1)
        pairs[0] += 0 if start else 1 + several
        many = pairs > 1
        goes_on = new_pair & many[of]
        if start:
            a, a_open, goes_on[0] = b.take(pa.array([0])), True, False
        if a_open:
            a_several, a_open = bool(many[int(start)]), last == int(start)
        if not new_pair.all():
            yield out(b.filter(pa.array(~new_pair)), COPY)
        if pending is not None and many[0]:
            yield out(pending, FIRST)
        if goes_on.any():
            yield out(b.filter(pa.array(goes_on)), FIRST)
        if last or many[0]:
            pending = None
        if new_pair.any():
            at = int(np.flatnonzero(new_pair)[-1])
            z, z_is_a = b.take(pa.array([at])), start and at == 0
            if last and not many[last] and not z_is_a:
                pending = z
        gram, whole, several = grams[-1], wholes[-1], bool(many[last])
    if a is not None:
        yield out(a, EDGE_SEVERAL if a_several else EDGE)
        if not z_is_a:
            yield out(z, SEEN if several else EDGE)


def settled(ranked: DataFrame) -> DataFrame:
    """The ranked rows with their edges decided: ``kind`` is COPY or FIRST. Two rows a range go to the driver."""
    edges = ranked.where(F.col("kind") >= EDGE).toArrow().to_pylist()
    edges.sort(key=lambda r: (r["gram"], r["whole"], r["key"], r["at"]))
    names: dict[int, set[int]] = {}
    several: set[int] = set()
    for r in edges:
        names.setdefault(r["gram"], set()).add(r["whole"])
        if r["kind"] != EDGE or len(names[r["gram"]]) > 1:
            several.add(r["gram"])
    decided, before = [], None
    for r in edges:
        if (r["gram"], r["whole"]) == before:
            decided.append(r | {"kind": COPY})
        elif r["kind"] != SEEN and r["gram"] in several:
            decided.append(r | {"kind": FIRST})
        before = r["gram"], r["whole"]
    rows = ranked.where(F.col("kind") < EDGE)
    return rows.union(ranked.sparkSession.createDataFrame([[r[c] for c in ranked.columns] for r in decided], ranked.schema)) if decided else rows


def packed(text: bytes) -> bytes:
    return len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, size, done = [], 0, 0
        for n, text in enumerate(utf8_rows(b.column(1)), 1):
            data.append(packed(text))
            size += len(data[-1])
            if size > TOGETHER or n == b.num_rows:
                rest = b.slice(done, n - done)
                yield pa.RecordBatch.from_arrays([rest.column(0), pa.array(data, pa.binary()), *rest.columns[2:]], ["key", "data", *b.schema.names[2:]])
                data, size, done = [], 0, n


def part_rows(least: int):
    """The bytes of all windows of each listed anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for b in batches:
            out: list[list] = [[] for _ in kinds]
            size = 0
            for n, (key, data, listed) in enumerate(zip(*b.columns, strict=True), 1):
                key, text = key.as_py(), unpacked(data.as_py())
                for x in listed.as_py():
                    at = x["at"]
                    first, last = (at >> 16) - (at >> 8 & 255), (at >> 16) - (at & 255)
                    for column, value in zip(out, (x["gram"], key, at, text[first : last + least]), strict=True):
                        column.append(value)
                    size += last + least - first
                if size > TOGETHER or n == b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["gram", "key", "at", "part"])
                    out, size = [[] for _ in kinds], 0

    return run


def blocks(least: int, gram: int) -> list[int]:
    """How many neighbouring windows the rounds take together: the string that they share is the doubled gram, then nearly the threshold, then the whole window."""
    double = least - 2 * gram + 1
    return sorted({max(1, double), max(1, isqrt(max(1, double))), 1}, reverse=True)


def split(block: int, least: int, gram: int):
    """Rows of anchors to rows of their blocks of windows, ranked by pairs: the rank so far with the longer string that the block's windows share, and the bytes of them all.

    Blocks begin at multiples of ``block`` before the anchor, so equal windows are in
    blocks of the same place and share the same string.
    """
    digest = xxhash.xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            longer, whole, keys, ats, parts = array("Q"), array("Q"), array("q"), array("q"), []
            for rank, key, at, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                hi, lo = at >> 8 & 255, at & 255
                for j in range(lo // block, hi // block + 1):
                    begin, end = j * block, min(j * block + block - 1, least - gram)
                    low, high = max(lo, begin), min(hi, end)
                    own = part[hi - high : hi - low + least]
                    longer.append(digest(part[hi - begin : hi - end + least], (rank ^ begin * 0x9E3779B97F4A7C15) & (1 << 64) - 1))
                    whole.append(digest(own, high << 8 | low))
                    keys.append(key)
                    ats.append(at >> 16 << 16 | high << 8 | low)
                    parts.append(own)
            columns = [pa.array(np.frombuffer(c, np.int64)) if len(c) else pa.array([], pa.int64()) for c in (longer, whole, keys, ats)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(parts, pa.binary())], ["gram", "whole", "key", "at", "part"])

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of sorted spans; touching ones are one run."""
    out: list[tuple[int, int]] = []
    for begin, end in spans:
        if out and begin <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((begin, end))
    return out


def cut(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for begin, end in runs:
        kept.append(text[at:begin])
        at = end
    return b"".join(kept) + text[at:]


def keyed(ws: Workspace, df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """``key`` (the document's place in the order), id and text. The id itself is the key unless ids repeat or are null."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if rows.groupBy("id").count().where("count > 1 or id is null").limit(1).count() == 0:
        return rows.select(F.col("id").cast("long").alias("key"), "id", "text")
    written = ws.save(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    order, _ = numbered(ws, written.select("id", "row", F.xxhash64("text").alias("h")), [F.col("id").asc_nulls_first(), "h", "row"], "order")
    return ws.save(written.join(order.select("row", F.col("pos").alias("key")), "row").select("key", "id", "text"), "keyed")


def repeated_spans(ws: Workspace, docs: DataFrame, least: int, gram: int) -> DataFrame:
    """Spans (key, begin, end) of bytes to remove; they may overlap."""
    n, order = partitions(ws.spark), ["gram", "whole", "key", "at"]
    sort = lambda rows: rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    texts = docs.select("key", "text")
    found = texts.mapInArrow(anchor_rows(least, gram), "gram long, whole long, key long, at long")
    ranked = settled(ws.save(sort(found).mapInArrow(rerank, "gram long, whole long, key long, at long, kind byte"), "ranked-0"))
    copies = [ranked.where(F.col("kind") == COPY).select("key", "at")]

    left = ranked.where(F.col("kind") == FIRST).select("key", F.struct("gram", "at").alias("x")).groupBy("key").agg(F.collect_list("x").alias("listed"))  # bounded by the document
    data = texts.mapInArrow(pack_rows, "key long, data binary")
    left = ws.save(data.join(left, "key").select("key", "data", "listed").mapInArrow(part_rows(least), "gram long, key long, at long, part binary"), "parts")
    for k, block in enumerate(blocks(least, gram), 1):
        if left.isEmpty():
            break
        pairs = left.mapInArrow(split(block, least, gram), "gram long, whole long, key long, at long, part binary")
        ranked = settled(ws.save(sort(pairs).mapInArrow(rerank, "gram long, whole long, key long, at long, part binary, kind byte"), f"ranked-{k}"))
        copies.append(ranked.where(F.col("kind") == COPY).select("key", "at"))
        left = ranked.where(F.col("kind") == FIRST).select("gram", "key", "at", "part")
    place = F.shiftright("at", 16)
    spans = [c.select("key", (place - F.shiftright("at", 8).bitwiseAND(F.lit(255))).alias("begin"), (place - F.col("at").bitwiseAND(F.lit(255)) + least).alias("end")) for c in copies]
    return reduce(DataFrame.union, spans)


def dedup(df: DataFrame, least: int = 100, gram: int = 32, with_text: bool = True, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Return id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte runs) and, if asked for, kept (the remaining bytes) of every row."""
    if not 0 < gram <= least <= gram + 255:
        raise ValueError("a gram is at most as long as a match, and shorter by at most 255 bytes")
    ws = Workspace(df.sparkSession, "suffix")
    docs = keyed(ws, df, text_col, id_col)
    spans = ws.save(repeated_spans(ws, docs, least, gram), "spans")
    lists = spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))  # bounded by the document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            size, removed, count, digest, runs_of, kept_of = [], [], [], [], [], []
            for data, listed in zip(b.column(1), b.column(2), strict=True):
                text = unpacked(data.as_py())
                runs = merged([(x["begin"], x["end"]) for x in listed.as_py() or ()])
                kept = cut(text, runs)
                size.append(len(text))
                removed.append(len(text) - len(kept))
                count.append(len(runs))
                digest.append(hashlib.sha256(kept).hexdigest())
                runs_of.append([{"begin": x, "end": y} for x, y in runs])
                kept_of.append(kept if with_text else None)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in (size, removed, count)), pa.array(digest, pa.string()), pa.array(runs_of, span), pa.array(kept_of, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    own = docs.schema["id"]
    data = docs.select("key", "text", "id").mapInArrow(pack_rows, T.StructType([T.StructField("key", T.LongType()), T.StructField("data", T.BinaryType()), own]))
    span = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([own, *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])
    out = data.join(lists, "key", "left").select("id", "data", "spans").mapInArrow(run, schema)
    return (out if with_text else out.drop("kept")).withColumnRenamed("id", id_col)
