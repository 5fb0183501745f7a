"""Substring dedup by hashing normalised lines, paragraphs and runs of sentences.

The pieces of a text are its sentences, which end with their line at the latest; pieces
without words go with their neighbours only. Units are made of whole pieces and have
``least`` words or more, so stock phrases ("All rights reserved.") count only as part of a
repeated passage: each line that is long enough; each paragraph (lines without a blank one
between); and from each piece the shortest long enough run of pieces that begins or ends
there, whatever lines it crosses. A repeated passage of whole pieces is thus removed from
its first to its last piece if it has ``least`` words, as lines of its own, in the middle of
a line, or across lines. A unit is normalised (case, punctuation, white space) and its
128-bit digest is grouped over the corpus with partial aggregation; the earliest ranked
occurrence (id, then place) stays and the rest is removed. A piece goes only where an
earlier unit holds it, so each piece's earliest place stays. Offsets are code points of the
original text.

Defined cases: a null or empty text has no units; a very long text is worked on whole, in
memory that grows with its units; a line, paragraph and run of the same pieces are one unit
(named in this order); rows that repeat an id rank alike, so
equal units at one place of one id are one occurrence and stay; null ids rank first; an
empty table gives an empty result. ``dedup`` carries other columns along unchanged,
whatever their names, but a column ``removed_spans`` is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinia.llm.common import Workspace

LINE = re.compile(r"[^\n]+")
SENTENCE = re.compile(r"[^.!?\n]*[^\s.!?\n][^.!?\n]*[.!?]*")
WORD = re.compile(r"[^\W_]+")
BLANK = re.compile(r"\n[^\S\n]*\n")


def pieces(text: str) -> Iterator[tuple[int, int, int, list[str]]]:
    """(line, begin, end, words) of the sentences with words; a line's first begins where the line does, its last ends with it."""
    for number, line in enumerate(LINE.finditer(text)):
        at = line.start()
        own = [(m, words) for m in SENTENCE.finditer(line[0]) if (words := WORD.findall(m[0].lower()))]
        for k, (m, words) in enumerate(own):
            begin = at + m.start() + len(m[0]) - len(m[0].lstrip()) if k else at
            yield number, begin, line.end() if k + 1 == len(own) else at + m.end(), words


def shortest_runs(sizes: list[int], least: int) -> Iterator[tuple[int, int]]:
    """(first, last) of the shortest runs with a sum of ``least`` or more that begin at each place."""
    total = end = 0
    for first, size in enumerate(sizes):
        while end < len(sizes) and total < least:
            total += sizes[end]
            end += 1
        if total < least:
            return
        yield first, end - 1
        total -= size


def units(text: str, least: int) -> list[tuple[int, int, int, bytes]]:
    """(level, begin, end, digest) of the lines (0), runs of pieces (1) and paragraphs (2) of ``least`` words or more."""
    lines, begins, ends, words = zip(*found, strict=True) if (found := list(pieces(text))) else ((), (), (), ())
    sizes = [len(w) for w in words]
    n = len(sizes)
    levels: dict[tuple[int, int], int] = {}
    line = paragraph = 0  # the first pieces of the line and the paragraph so far
    for k in range(1, n + 1):
        if k < n and lines[k] == lines[k - 1]:
            continue
        if sum(sizes[line:k]) >= least:
            levels[line, k - 1] = 0
        line = k
        # lines of signs alone don't end a paragraph, blank ones do
        if k == n or BLANK.search(text, ends[k - 1], begins[k]):
            if sum(sizes[paragraph:k]) >= least:
                levels.setdefault((paragraph, k - 1), 2)
            paragraph = k
    for first, last in shortest_runs(sizes, least):
        levels.setdefault((first, last), 1)
    for first, last in shortest_runs(sizes[::-1], least):  # those that end at each place
        levels.setdefault((n - 1 - last, n - 1 - first), 1)
    spelt = [" ".join(w) for w in words]
    return [(v, begins[i], ends[j], xxhash.xxh3_128_digest(" ".join(spelt[i : j + 1]))) for (i, j), v in levels.items()]


def repeated_units(ws: Workspace, df: DataFrame, least: int = 16, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each unit to remove: id, level, begin, end, kept_id, kept_begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, level, begin, end, digest = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for v, s, e, d in units(t or "", least):
                    own.append(i)
                    level.append(v)
                    begin.append(s)
                    end.append(e)
                    digest.append(d)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own, pa.int32())), pa.array(level, pa.int8()), pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(digest, pa.binary())], ["id", "level", "begin", "end", "digest"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("level", T.ByteType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("digest", T.BinaryType())])
    found = ws.save(rows.mapInArrow(run, schema), "found")
    keep = ws.save(found.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("id", "begin")).alias("first")).where("n > 1").select("digest", F.col("first.id").alias("kept_id"), F.col("first.begin").alias("kept_begin")), "keep")
    return found.join(keep, "digest").where(~(F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("begin") == F.col("kept_begin")))).select("id", "level", "begin", "end", "kept_id", "kept_begin")


def removed(df: DataFrame, least: int = 16, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    return repeated_units(Workspace(df.sparkSession, "substrings"), df, least, text_col, id_col)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, which may overlap; lines that are cut whole go with their line feed."""
    joined: list[list[int]] = []
    for begin, end in sorted(spans):
        if joined and begin <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([begin, end])
    out, at = [], 0
    for begin, end in joined:
        out.append(text[at:begin])
        at = end + 1 if (begin == 0 or text[begin - 1] == "\n") and text[end : end + 1] == "\n" else end
    return "".join(out) + text[at:]


def dedup(df: DataFrame, least: int = 16, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The table with repeated units cut out of its texts, and ``removed_spans`` in code points of the original text."""
    ws = Workspace(df.sparkSession, "substrings")
    gone = ws.save(repeated_units(ws, df, least, text_col, id_col), "gone")
    lists = gone.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("spans"))  # bounded by the document
    df = df.drop("removed_spans")
    # the table's own columns travel in one, so their names meet none of these
    own = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), F.col(id_col).alias("own_id"), F.col(text_col).alias("text"))
    rows = own.join(lists.hint("merge"), F.col("own_id").eqNullSafe(F.col("id")), "left").select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if t is None or not s else cut(t, [(x["begin"], x["end"]) for x in s]) for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, b.schema.field(1).type), b.column(2)], b.schema.names)

    done = rows.mapInArrow(run, rows.schema)
    return done.select(*[F.col("text").alias(text_col) if c == text_col else F.col("row")[c].alias(c) for c in df.columns], F.col("spans").alias("removed_spans"))
