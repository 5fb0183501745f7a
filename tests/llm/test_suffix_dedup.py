import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from vicinia.llm import suffix_dedup
from vicinia.llm.suffix_dedup import anchors, dedup, merged


def table(seed, letters, n=40):
    rng = random.Random(seed)
    passages = ["".join(rng.choice(letters) for _ in range(rng.randrange(20, 160))) for _ in range(6)]
    rows = []
    for k in range(n):
        t = "".join(rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(rng.randrange(8)))
        rows.append((k * 3 - 20, t))
    return rows


def same(out, rows, least):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept, r.kept_sha256) for r in out.collect()}
    want = {k: (*x, hashlib.sha256(x[3]).hexdigest()) for (k, _), x in zip(rows, brute.substring_dedup(rows, least), strict=True)}
    assert got == want


@pytest.mark.parametrize(("seed", "letters"), [(1, "abcdefgh"), (2, "ab"), (3, "aé日 b"), (4, "a")])
def test_equals_brute_force(docs, seed, letters):
    rows = [*table(seed, letters), (500, None), (501, ""), (502, "x" * 5000)]
    same(dedup(docs(rows), least=50, gram=16), rows, 50)


def test_default_sizes_and_parts(docs, monkeypatch, words):
    monkeypatch.setattr(suffix_dedup, "PART", 300)  # a text falls into many parts
    shared = words(9, 60)
    rows = [(k, words(k, 80) + shared + words(k + 100, 30 * (k % 4))) for k in range(25)] + [(90, words(3, 80) + shared), (91, shared[:140]), (92, shared + shared)]
    same(dedup(docs(rows)), rows, 100)


def test_repeated_and_null_ids_rank_by_text(docs, words):
    t = words(1, 40)
    rows = [(None, t), (3, t), (3, t), (2, words(2, 40))]
    out = dedup(docs(rows)).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in out) == [("2", 0), ("3", len(t)), ("3", len(t)), ("None", 0)]


def test_anchors_cover_all_windows():
    b = np.frombuffer(("abcab" * 40 + "".join(map(chr, range(33, 120))) * 3).encode(), np.uint8)
    _, _, place, first, last = anchors(b, 50, 16)
    assert first[0] == 0 and last[-1] == len(b) - 50 and (first[1:] == last[:-1] + 1).all()
    assert (place >= last).all() and (place + 16 <= first + 50).all()


@pytest.mark.parametrize("seed", range(12))
def test_ranking_whatever_the_ranges(spark, seed):
    """Rows cut into ranges and batches anywhere: the same copies and first ones."""
    rng = random.Random(seed)
    rows = sorted((rng.randrange(1 + seed), rng.randrange(3), k, 0) for k in range(60))
    cuts = sorted(rng.sample(range(61), 7))
    found = []
    for a, b in zip([0, *cuts], [*cuts, 60], strict=True):
        mids = sorted(rng.sample(range(a, b + 1), min(2, b - a)))
        batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[x:y]], pa.int64()) for c in range(4)], ["gram", "whole", "key", "at"]) for x, y in zip([a, *mids], [*mids, b], strict=True)]
        for out in suffix_dedup.rerank(iter(batches)):
            found += [tuple(r.values()) for r in out.to_pylist()]
    ranked = spark.createDataFrame(found, "gram long, whole long, key long, at long, kind byte")
    got = {(r.key, r.kind) for r in suffix_dedup.settled(ranked).collect()}
    want = set()
    for g in {r[0] for r in rows}:
        names = {r[1] for r in rows if r[0] == g}
        for w in names:
            first, *rest = [r[2] for r in rows if r[:2] == (g, w)]
            want |= {(k, suffix_dedup.COPY) for k in rest} | ({(first, suffix_dedup.FIRST)} if len(names) > 1 else set())
    assert got == want and len(found) == len(set(found))


def test_hot_passage(docs, words):
    """A passage in many contexts, a third of them alike on one side."""
    passage = words(5, 40)
    rows = [(k, words(k % 7 + 100, 20) + " " + passage + " " + words(k, 15)) for k in range(120)]
    same(dedup(docs(rows)), rows, 100)


def test_merging():
    assert merged([(0, 5), (2, 3), (5, 7), (9, 12)]) == [(0, 7), (9, 12)]


def test_empty(docs):
    assert dedup(docs([])).collect() == []
