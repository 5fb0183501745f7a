"""Importance resampling against plain strings, and composed CRCs against whole ones."""

import hashlib
import math
import re
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vicinia.llm import resampling


def plain_features(text, width):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return words, [" ".join(words[i : i + n]) for n in range(1, width + 1) for i in range(len(words) - n + 1)]


def plain(rows, target, width, buckets, least_words, percent, seed=2024):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for f in plain_features(t, width)[1]:
                out[crc32(f.encode()) % buckets] += 1
        return out

    s, t = counts(t for _, t in rows), counts(target)
    gain = [math.floor(1000 * math.log((t[k] + 1.0) * (sum(s) + buckets) / ((s[k] + 1.0) * (sum(t) + buckets)))) for k in range(buckets)]
    out = []
    for k, text in rows:
        words, found = plain_features(text, width)
        weight = sum(gain[crc32(f.encode()) % buckets] for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words)])
    able = sorted((r for r in out if r[4] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(able[: len(able) * percent // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=20), st.binary(max_size=300))
def test_combined_is_the_whole_crc(left, right):
    a, b = np.array([crc32(x) for x in left], np.uint32), np.full(len(left), crc32(right), np.uint32)
    assert resampling.combined(a, b, np.full(len(left), len(right))).tolist() == [crc32(x + right) for x in left]


@pytest.mark.parametrize("width", [1, 2, 4])
def test_features_over_blocks(monkeypatch, width):
    text = "Été one TWO three3 4four, x y z; Zed " * 7
    want = sorted(crc32(f.encode()) for f in plain_features(text, width)[1])
    for block in (1, 9, 30, 65536):
        monkeypatch.setattr(resampling, "BLOCK", block)
        got = list(resampling.features(text.encode(), width))
        assert sorted(x for _, c in got for x in c.tolist()) == want and sum(n for n, _ in got) == 63


@pytest.mark.parametrize("width", [1, 3])
def test_resample_equals_plain(spark, docs, words, width):
    rows = [(k, words(k % 50, 5 + 3 * (k % 20), 60)) for k in range(120)] + [(7, "short"), (None, words(3, 40, 60)), (500, None), (501, ""), (502, words(1, 30000, 90)), (503, " .,\t!")]
    target = [words(900 + k, 30, 30) for k in range(20)] + [None, ""]
    items = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(docs(rows), items, width=width, buckets=97, least_words=20, percent=25)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, target, width, 97, 20, 25)


def test_equal_scores_go_by_id(spark, monkeypatch):
    monkeypatch.setattr(resampling, "noise", lambda seed, key: 0)
    df = spark.createDataFrame([(k, "a b c d") for k in (9, 4, 6, 1)], "doc_id long, text string")
    got = resampling.resample(df, df, buckets=10, least_words=2, percent=50).orderBy("doc_id").collect()
    assert [(r.doc_id, r["rank"]) for r in got] == [(1, 1), (4, 2), (6, None), (9, None)]


def test_empty_tables(spark, docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(docs([]), items).collect() == []
    got = resampling.resample(docs([(1, "a b")]), items, buckets=10, least_words=1, percent=100).collect()
    assert [(r.n_features, r["rank"]) for r in got] == [(2, 1)]
