"""Phrases whose words stand together more often than their parts would: exact counts behind sketched bounds.

1. One scan counts words exactly and all two-word phrases in a sketch: two hashed cells a
   phrase, each an upper bound of its count. Cells travel as sparse blocks and are added up
   in order of blocks, a block at a time.
2. A second scan keeps of each text the maximal runs of words whose neighbours all have
   bounds of ``least`` or more (``fragments``), each once with its count. No phrase that is
   frequent enough lies elsewhere, so the corpus isn't read again.
3. Fragments are sketched for phrases of three and four words; what passes all its bounds is
   a candidate. Candidates are dealt into shards by a hash of their first two words, and each
   shard gets the stretches of fragments in which one of its candidates can begin, equal
   stretches once with their count.
4. In each shard the candidates, guarded by blanks on both sides, compile into
   pyahocorasick automata (one a language) which count their overlapping matches in the
   shard's stretches. Candidates come first in a task's sorted stream and stretches after
   them, so a task holds one shard's candidates and one batch. Each shard is dealt over
   ``SALTS`` tasks.
5. The sums are exact; thresholds, cuts, containment and ranks are DataFrame functions on
   decimals.

Sketches have a cell for each 64 bytes of text, up to ``CELLS`` of each depth (64 MB of bits
then, the most that is broadcast at once is twice that); beyond that bounds get looser and
candidates more, results stay the same.

Defined cases: a null language counts as ``und``; null and blank texts have no words; phrases
never cross a separator nor a document, and a stretch of text without any separator is held
whole; repeated rows count again; ties are ranked by count and phrase; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinia.llm.common import WordHashes, Workspace, partitions, phrase_hashes, splitmix, utf8_rows

LONGEST = 4
#: Cells of a sketch's depth at most.
CELLS = 1 << 29
#: Candidates of a shard, about.
PATTERNS = 50_000
SALTS = 4
BLOCK = 1 << 20  # bytes of text that are split into words at once
HELD = 1 << 17  # different strings that a task holds before it passes them on
BUFFER = 1 << 20  # cells that a task holds before it passes them on
SPAN = 1 << 16  # cells of a block
TABLE = bytes(ord(".") if chr(c) in ".,;:!?" or 10 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))


class Vocabulary(dict):
    """A number of each word, in order of first sight, with its hash (0 of the separator) and its counts by language."""

    def __init__(self):
        super().__init__()
        self.hashes, self.counts, self.held = [], {}, np.empty(0, np.uint64)
        self[b"."]  # number 0

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word) | 1 if out else 0)
        return out

    def counted(self, lang: str, words: list[bytes]) -> np.ndarray:
        """The words' hashes; they count."""
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        known, n = self.counts.get(lang, np.empty(0, np.int64)), np.bincount(numbers, minlength=len(self.hashes))
        n[: len(known)] += known
        self.counts[lang] = n
        if len(self.held) < len(self.hashes):
            self.held = np.concatenate((self.held, np.array(self.hashes[len(self.held) :], np.uint64)))
        return self.held[numbers]

    def rows(self) -> Iterator[tuple[str, pa.Array, pa.Array]]:
        """(lang, words, counts) so far."""
        words = pa.array(self, pa.binary()).cast(pa.string())  # a dict's keys, in order of their numbers
        for lang, n in self.counts.items():
            at = np.flatnonzero(n[1:]) + 1
            yield lang, words.take(pa.array(at)), pa.array(n[at])


def words_of(block: bytes) -> list[bytes]:
    """The words of a text; a separator is a word of its own."""
    return block.translate(TABLE).replace(b".", b" . ").split()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Languages and the words of some of their texts (lang, text), a block at a time, with a separator between texts."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), utf8_rows(b.column(1)), strict=True):
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size >= BLOCK:
                for k, texts in held.items():
                    yield k, words_of(b".".join(texts))
                held, size = {}, 0
    for k, texts in held.items():
        yield k, words_of(b".".join(texts))


def _salted(h: np.ndarray, lang: np.uint64 | np.ndarray) -> np.ndarray:
    return np.where(h == 0, np.uint64(0), (h ^ lang) | np.uint64(1))


def cells_of(g: np.ndarray, width: int, order: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of each phrase hash in the part of the sketch for this order."""
    low, mask = order * 2 * width, np.uint64(width - 1)
    return (g >> np.uint64(1) & mask).astype(np.int64) + low, (g >> np.uint64(33) & mask).astype(np.int64) + low + width


class Sums:
    """Counts of cells, passed on as sparse blocks: block, offsets (uint16) and counts (uint32, ``least`` at most, which keeps bounds of ``least`` exact)."""

    def __init__(self, least: int):
        self.least, self.cells, self.counts, self.size = least, [], [], 0

    def add(self, cells: np.ndarray, counts: np.ndarray | None = None) -> Iterator[tuple[int, bytes, bytes]]:
        """``counts``: of each cell (1); given always or never."""
        for at in range(0, len(cells), BUFFER):
            part = cells[at : at + BUFFER]
            self.cells.append(part)
            if counts is not None:
                self.counts.append(counts[at : at + BUFFER])
            self.size += len(part)
            if self.size >= BUFFER:
                yield from self.flush()

    def flush(self) -> Iterator[tuple[int, bytes, bytes]]:
        if not self.size:
            return
        cells, counts = np.concatenate(self.cells), np.concatenate(self.counts) if self.counts else None
        self.cells, self.counts, self.size = [], [], 0
        if counts is None:
            cells.sort()
        else:
            order = np.argsort(cells)
            cells, counts = cells[order], counts[order]
        first = np.flatnonzero(np.diff(cells, prepend=-1))
        total = np.diff(first, append=len(cells)) if counts is None else np.add.reduceat(counts, first)
        cells, total = cells[first], np.minimum(total, self.least).astype(np.uint32)
        cuts = np.flatnonzero(np.diff(cells // SPAN, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(cells)], strict=True):
            yield int(cells[a] // SPAN), (cells[a:b] % SPAN).astype(np.uint16).tobytes(), total[a:b].tobytes()


def _heavy(ws: Workspace, blocks: DataFrame, least: int, size: int) -> np.ndarray:
    """A bit for each cell of the sketch: whether its sum is ``least`` or more; ``size`` / 8 bytes."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(SPAN, np.int64)

        def bits() -> Iterator[pa.RecordBatch]:
            if now is not None and (heavy := total >= least).any():
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(heavy, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

        for b in batches:
            for block, offsets, counts in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if block != now:
                    yield from bits()
                    now = block
                    total[:] = 0
                total[np.frombuffer(offsets, np.uint16)] += np.frombuffer(counts, np.uint32)
        yield from bits()

    dealt = blocks.repartition(partitions(ws.spark), "block").sortWithinPartitions("block").mapInArrow(added, "block int, bits binary")
    out = np.zeros((-(-size // SPAN), SPAN // 8), np.uint8)
    found = dealt.toArrow()  # CELLS / 2 bytes at most
    for block, bits in zip(found["block"].to_pylist(), found["bits"].to_pylist(), strict=True):
        out[block] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def _bounded(bits: np.ndarray, g: np.ndarray, width: int, order: int = 0) -> np.ndarray:
    """Whether both cells of each phrase hash are heavy; never across a separator."""
    out = g != 0
    for cells in cells_of(g, width, order):
        out &= (bits[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool)
    return out


def _language(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang) & ~1)


def _first_scan(docs: DataFrame, least: int, width: int) -> DataFrame:
    """Words (lang, word, n) and sketch blocks (block, offsets, counts) of two-word phrases, in one table."""
    schema = "lang string, word string, n long, block int, offsets binary, counts binary"
    names = schema.replace(",", "").split()[::2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, vocabulary = Sums(least), Vocabulary()

        def cells(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
            block, offsets, counts = zip(*rows, strict=True)
            none = [pa.nulls(len(rows), t) for t in (pa.string(), pa.string(), pa.int64())]
            return pa.RecordBatch.from_arrays([*none, pa.array(block, pa.int32()), pa.array(offsets, pa.binary()), pa.array(counts, pa.binary())], names)

        def words() -> Iterator[pa.RecordBatch]:
            for lang, own, n in vocabulary.rows():
                none = [pa.nulls(len(own), t) for t in (pa.int32(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), own, n, *none], names)

        for lang, found in _texts(batches):
            g = phrase_hashes(_salted(vocabulary.counted(lang, found), _language(lang)), 2)
            for c in cells_of(g[g != 0], width):
                if rows := list(sums.add(c)):
                    yield cells(rows)
            if len(vocabulary) > HELD:
                yield from words()
                vocabulary = Vocabulary()
        if rows := list(sums.flush()):
            yield cells(rows)
        yield from words()

    return docs.mapInArrow(run, schema)


def _fragments(docs: DataFrame, held, width: int) -> DataFrame:
    """(lang, text, n): maximal runs of two words or more whose neighbours may all be frequent; ``held``: the broadcast bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hashes, counted, size = held.value, WordHashes(b"."), defaultdict(Counter), 0
        for lang, found in _texts(batches):
            near = np.zeros(len(found) + 1, np.int8)
            if len(found) > 1:
                near[1:-1] = _bounded(bits, phrase_hashes(_salted(hashes.of(found), _language(lang)), 2), width)
            step = np.diff(near)  # at the first word of a run 1, at its last -1
            runs = zip(np.flatnonzero(step == 1).tolist(), (np.flatnonzero(step == -1) + 1).tolist(), strict=True)
            before = len(counted[lang])
            counted[lang].update([b" ".join(found[a:b]) for a, b in runs])
            size += len(counted[lang]) - before
            if size > HELD:
                yield from _strings(counted)
                counted, size = defaultdict(Counter), 0
        yield from _strings(counted)

    return docs.mapInArrow(run, "lang string, text string, n long").groupBy("lang", "text").agg(F.sum("n").alias("n"))


def _strings(counted: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, n in counted.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(n, pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64())], ["lang", "text", "n"])


def _runs(b: pa.RecordBatch, hashes: WordHashes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Of a batch of fragments (lang, text, n) the words, with a separator between fragments, each word's fragment and salted hash."""
    texts = [x.as_buffer().to_pybytes() for x in b.column(1)]
    found = b" . ".join(texts).split(b" ")
    of = np.repeat(np.arange(len(texts)), [t.count(b" ") + 2 for t in texts])[: len(found)]
    lang = np.array([_language(x) for x in b.column(0).to_pylist()], np.uint64)
    return found, of, _salted(hashes.of(found), lang[of])


def _longer(fragments: DataFrame, least: int, width: int) -> DataFrame:
    """Sketch blocks of the fragments' phrases of three words and more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sums = WordHashes(b"."), Sums(least)

        def rows(found: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "offsets", "counts"])

        for b in batches:
            if not b.num_rows:
                continue
            _, of, h = _runs(b, hashes)
            n, g = b.column(2).to_numpy(), h
            for size in range(2, LONGEST + 1):
                g = phrase_hashes(h, size, g)
                if size > 2:
                    at = np.flatnonzero(g)
                    for c in cells_of(g[at], width, size - 3):
                        yield from rows(list(sums.add(c, n[of[at]])))
        yield from rows(list(sums.flush()))

    return fragments.mapInArrow(run, "block int, offsets binary, counts binary")


def _routed(fragments: DataFrame, held, width: int, shards: int) -> DataFrame:
    """(lang, shard, scanned, text, n): candidates (not scanned), and for each shard the stretches where its candidates may begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hashes = held.value, WordHashes(b".")
        for b in batches:
            if not b.num_rows:
                continue
            found, of, h = _runs(b, hashes)
            g = {1: h}
            for size in range(2, LONGEST + 1):
                g[size] = phrase_hashes(h, size, g[size - 1])
            may = {2: g[2] != 0}
            for size in range(3, LONGEST + 1):  # a phrase is no more frequent than the phrases in it
                bound = _bounded(bits, g[size], width, size - 3)
                may[size] = bound & may[size - 1][: len(bound)] & may[size - 1][1 : len(bound) + 1]
            at = np.flatnonzero(may[2])
            shard = (splitmix(g[2][at]) % np.uint64(shards)).astype(np.int64)
            reach = np.full(len(found) + 1, 0)
            rows: Counter = Counter()
            shard_at = np.zeros(len(found) + 1, np.int64)
            shard_at[at] = shard
            for size in range(2, LONGEST + 1):
                own = np.flatnonzero(may[size])
                reach[own] = size
                for i in own[np.unique(g[size][own], return_index=True)[1]].tolist():
                    rows[int(of[i]), int(shard_at[i]), False, b" ".join(found[i : i + size])] = 0
            order = np.argsort(shard, kind="stable")  # by shard and place
            base, s = len(found) + LONGEST, shard[order]
            begin, end = s * base + at[order], np.maximum.accumulate(s * base + at[order] + reach[at[order]])
            first = np.flatnonzero(np.concatenate(([True], begin[1:] >= end[:-1]))) if len(at) else np.empty(0, np.int64)
            last = np.concatenate((first[1:], [len(at)]))[: len(first)] - 1
            n = b.column(2).to_numpy()
            for k, a, z in zip(s[first].tolist(), (begin[first] % base).tolist(), (end[last] - s[last] * base).tolist(), strict=True):
                rows[int(of[a]), k, True, b" ".join(found[a:z])] += int(n[of[a]])
            lang = b.column(0).take(pa.array([k[0] for k in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([lang, pa.array([k[1] for k in rows], pa.int32()), pa.array([k[2] for k in rows], pa.bool_()), pa.array([k[3] for k in rows], pa.binary()).cast(pa.string()), pa.array(list(rows.values()), pa.int64())], ["lang", "shard", "scanned", "text", "n"])

    return fragments.mapInArrow(run, "lang string, shard int, scanned boolean, text string, n long").groupBy("lang", "shard", "scanned", "text").agg(F.sum("n").alias("n"))


def _scanned(ws: Workspace, routed: DataFrame) -> DataFrame:
    """(lang, phrase, a): overlapping matches of each shard's automata in its stretches, counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        at, tries, counts = None, {}, {}

        def matched() -> Iterator[pa.RecordBatch]:
            for lang, found in counts.items():
                own = [(p, n) for p, n in zip(tries[lang][1], found, strict=True) if n]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array([p for p, _ in own], pa.string()), pa.array([n for _, n in own], pa.int64())], ["lang", "phrase", "a"])

        for b in batches:
            for shard, salt, scanned, lang, text, n in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if (shard, salt) != at:
                    yield from matched()
                    at, tries, counts = (shard, salt), {}, {}
                if not scanned:
                    trie, phrases = tries.setdefault(lang, (ahocorasick.Automaton(), []))
                    trie.add_word(f" {text} ", len(phrases))
                    phrases.append(text)
                    continue
                if lang not in counts:
                    tries[lang][0].make_automaton()
                    counts[lang] = [0] * len(tries[lang][1])
                own = counts[lang]
                for _, k in tries[lang][0].iter(f" {text} "):
                    own[k] += n
        yield from matched()

    columns = ["shard", "salt", "scanned", "lang", "text", "n"]
    candidates = routed.where(~F.col("scanned")).withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    stretches = routed.where("scanned").withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int"))
    dealt = candidates.select(*columns).union(stretches.select(*columns)).repartition(partitions(ws.spark), "shard", "salt")
    return dealt.sortWithinPartitions("shard", "salt", "scanned").mapInArrow(run, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def _part(words, start, length):
    return F.array_join(F.slice(words, start, length), " ")


def _scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """phrases (lang, phrase, a) with l, r and score of their lowest-scoring cut; every part is as frequent as its phrase and so is counted."""
    known = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")).union(words.select("lang", "word", "n"))
    split = phrases.withColumn("w", F.split("phrase", " ", -1)).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = split.select("lang", "phrase", "a", "k", _part("w", F.lit(1), F.col("k")).alias("left"), _part("w", F.col("k") + 1, F.size("w")).alias("right"))
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("part").alias(side), F.col("f").alias(count)).hint("merge"), ["lang", side])
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000) div (l + r)")
    low = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return low.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _contained(phrases: DataFrame, percent: int) -> DataFrame:
    """(lang, phrase) of the phrases inside a longer one that is nearly as frequent."""
    w = F.col("w")
    within = [F.when(F.size(w) - i >= n, _part(w, F.lit(i + 1), F.lit(n))) for n in range(2, LONGEST) for i in range(LONGEST - n + 1)]
    long = phrases.withColumn("w", F.split("phrase", " ", -1)).where(F.size("w") > 2)
    inner = long.select("lang", F.col("phrase").alias("longer"), F.col("a").alias("f"), F.explode(F.array(*within)).alias("phrase")).where("phrase is not null and phrase <> longer")
    most = inner.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    return phrases.join(most.hint("merge"), ["lang", "phrase"]).where(F.expr(f"cast(f as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * {int(percent)}")).select("lang", "phrase")


def collocations(df: DataFrame, least: int = 30, percent: int = 80, most: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Return lang, rank, phrase, a, l, r, n and score of each language's ``most`` best phrases of 2 to 4 words.

    a, l and r count the phrase and the parts of its lowest-scoring cut, n all words of the
    language; score is floor(2000000 a / (l + r)). Candidates have ``a`` of ``least`` or more;
    those inside a longer candidate with ``percent`` of their count or more are dropped.
    """
    ws = Workspace(df.sparkSession, "collocations")
    context = ws.spark.sparkContext
    docs = df.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = min(CELLS, max(SPAN, 1 << (size // 64).bit_length()))
    first = ws.save(_first_scan(docs, least, width), "first")
    words = ws.save(first.where("word is not null").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    pairs = _heavy(ws, first.where("block is not null").select("block", "offsets", "counts"), least, 2 * width)
    ws.drop("first")
    held = context.broadcast(pairs)
    fragments = ws.save(_fragments(docs, held, width), "fragments")
    narrow = max(SPAN, width // 2)  # each order of longer phrases has far fewer than all pairs
    longer = _heavy(ws, _longer(fragments, least, narrow), least, 2 * narrow * (LONGEST - 2))
    held_longer = context.broadcast(longer)
    guess = sum(int(np.bitwise_count(x).sum()) for x in (pairs, longer)) // 2  # each candidate has two heavy cells
    shards = max(partitions(ws.spark), -(-guess // PATTERNS))
    routed = ws.save(_routed(fragments, held_longer, narrow, shards), "routed")
    held.destroy()
    ws.drop("fragments")
    phrases = ws.save(_scanned(ws, routed).where(F.col("a") >= least), "phrases")
    held_longer.destroy()
    frequent = words.where(F.col("n") >= least)
    kept = _scored(phrases, frequent).join(_contained(phrases, percent).hint("merge"), ["lang", "phrase"], "left_anti")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = kept.withColumn("rank", place.cast("long")).where(F.col("rank") <= most)
    whole = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(whole.hint("merge"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
