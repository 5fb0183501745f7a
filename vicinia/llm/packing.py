"""Best-fit packing of tokenised documents into sequences of a fixed length.

Bulk-synchronous best-fit. Pieces are range-sorted by length, longest first, and
numbered without being gathered (one count a partition goes to the driver). A superstep
takes the longest length left and sweeps the gaps upward from it: its pieces, in rank
order, take the sequences of the smallest gap that holds them (the successor), the ranks
that found none go on to the next gap, and what is left opens new sequences; then the
gaps are updated and the next superstep begins. Pieces of one length are alike, and so
are sequences of one gap, so a superstep works on runs (length, ranks, sequences). There
are at most ``capacity`` lengths and gaps, so the sweep's state is bounded by the
capacity alone, whatever the number of documents. The result is that of best-fit
decreasing. Each partition then looks its pieces up in the broadcast runs.

Tokens come from a public tokenizer file. A chunk between spaces is tokenised once and
remembered (a bounded memory); texts with adjacent white space go whole to the tokenizer.

Defined cases: a null text is empty; an empty text is one piece, the end token alone; a
very long text is tokenised whole and cut into pieces; pieces of one length go by id, then
place, then checksum; repeated rows are documents of their own; a null id sorts first; an empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinia.llm.common import Workspace, numbered, one_thread

#: Chunks, and parts of chunks, that a worker remembers with their tokens: some 150 MB when full.
REMEMBERED, PARTS = 800_000, 400_000
#: The public byte-level BPE's pattern, which splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Without these no white space spans two chunks: single spaces and line feeds only.
TOGETHER = ("  ", "\n\n", " \n", "\n ", "\x00", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))


def plain(text: str) -> bool:
    return not text[:1].isspace() and not any(x in text for x in TOGETHER)


def _byte_letters() -> dict[int, str]:
    """The letters for bytes in a byte-level BPE's vocabulary: printable ones stand for themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Tokens(dict):
    """Little-endian 32-bit ids of texts; as a dict, those of chunks.

    A chunk's key is the text after a space; a key that begins with U+0000 has no space before it.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # their strings in a text are ordinary text
        self.whole.no_truncation()
        self.model, self.split, self.letters = self.whole.model, regex.compile(PATTERN).findall, _byte_letters()
        self.parts: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        text = key if key == "\n" else key[1:] if key[:1] == "\x00" else " " + key
        out = self[key] = self.part(text) if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()) else b"".join(map(self.part, self.split(text)))
        return out

    def part(self, text: str) -> bytes:
        """Tokens of what the pattern doesn't split."""
        if (out := self.parts.get(text)) is None:
            if len(self.parts) >= PARTS:
                self.parts.clear()
            ids = array("I", [t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.letters))])
            out = self.parts[text] = ids.tobytes() if sys.byteorder == "little" else np.array(ids, dtype="<u4").tobytes()
        return out

    def of(self, text: str) -> bytes:
        if not plain(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.__getitem__, ("\x00" + text.replace("\n", " \n \x00")).split(" ")))


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    one_thread()
    return Tokens(path)


def pieces(df: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Return a row for each piece of each document: id, piece, start, length, crc (of its ids as little-endian words)."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokens(tokenizer)
        for b in batches:
            own, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = known.of(t or "") + end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    stop = at + (n - at - 1) % capacity + 1  # the first piece takes the remainder
                    own.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(stop - at)
                    crc.append(zlib.crc32(ids[4 * at : 4 * stop]))
                    at, k = stop, k + 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "crc"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "crc"))])
    return rows.mapInArrow(cut, schema)


def best_fit(lengths: list[int], counts: list[int], capacity: int) -> np.ndarray:
    """Best-fit supersteps over runs; lengths in descending order.

    Returns rows (first rank, first sequence, pieces a sequence, first offset, length):
    from its first rank on, a run fills sequence after sequence, so many pieces in each.
    Ranks count all pieces from 0, longest first.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs (first sequence, sequences)
    out, rank, opened = [], 0, 0
    for length, left in zip(lengths, counts, strict=True):
        later: list[tuple[int, int, int]] = []  # gaps that this superstep makes are there for the next
        for gap in sorted(g for g in gaps if g >= length):
            each = gap // length
            while left and gaps[gap]:
                first, n = gaps[gap].pop()
                full = min(n, left // each)
                rest = left - full * each if full < n else 0  # pieces for one sequence that they don't fill
                for seqs, per, seq in ((full, each, first), (1, rest, first + full)):
                    if seqs and per:
                        out.append((rank, seq, per, capacity - gap, length))
                        rank, left = rank + seqs * per, left - seqs * per
                        later.append((gap - per * length, seq, seqs))
                if (used := full + (rest > 0)) < n:
                    gaps[gap].append((first + used, n - used))
            if not gaps[gap]:
                del gaps[gap]
            if not left:
                break
        each = capacity // length
        for seqs, per in ((left // each, each), (1, left % each)):
            if seqs and per:
                out.append((rank, opened, per, 0, length))
                later.append((capacity - per * length, opened, seqs))
                rank, opened = rank + seqs * per, opened + seqs
        for gap, seq, n in later:
            if gap:
                gaps.setdefault(gap, []).append((seq, n))
    return np.array(out, dtype=np.int64).reshape(-1, 5)


def pack(df: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Return id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    ws = Workspace(df.sparkSession, "packing")
    cut = ws.save(pieces(df, tokenizer, capacity, end_id, text_col, id_col), "pieces")
    ranked, _ = numbered(ws, cut, [F.col("length").desc(), "id", "piece", "crc"], "ranked")
    hist = cut.groupBy("length").count().toArrow().sort_by([("length", "descending")])  # at most ``capacity`` rows
    runs = df.sparkSession.sparkContext.broadcast(best_fit(hist["length"].to_pylist(), hist["count"].to_pylist(), capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seq, per, offset, length = runs.value.T
        for b in batches:
            pos = b.column(b.num_columns - 1).to_numpy()
            r = np.searchsorted(first, pos, side="right") - 1
            k = pos - first[r]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seq[r] + k // per[r]), pa.array(offset[r] + k % per[r] * length[r])], ["id", "piece", "start", "length", "crc", "sequence_id", "offset"])

    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema).select(F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")
