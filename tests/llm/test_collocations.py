"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pytest

from vicinia.llm import collocations as module
from vicinia.llm.collocations import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, percent, most):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        held = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + k] for p, a in held.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= percent * held[p[i : i + k]]}
        best = []
        for p, a in held.items():
            if p not in gone:
                score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:most])]
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "a", "New", "york", "é", "x\x00y", "日本", "a-b", "10%", "(b)", "to"]
    fixed = ["in the course of the year", "New York City", "a a a a a a", "to be or not to be", "\t of  the\t"]
    out = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else " ".join(rng.choices(words, k=rng.randrange(1, 7))) for _ in range(rng.randrange(1, 20))]
        out.append((rng.choice(["en", "de", None, "und", ""]), "".join(p + rng.choice([" ", ". ", ",", "\n", ";", "?!", "\t", ": ", "\x0b", " "]) for p in parts)))
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "lang string, text string").selectExpr("lang", "text", "1 as doc_id", "'x' as word", "'y' as shard", "'z' as n", "1 as block", "2 as phrase").repartition(parts)


@pytest.mark.parametrize("least, percent, most", [(3, 80, 2000), (5, 50, 7), (1, 100, 100)])
def test_equals_plain(spark, least, percent, most):
    rows = [*texts(least, 120), ("en", None), ("en", ""), (None, " . "), ("en", "word"), *[("en", "One copy of one text stands here in many rows.")] * 9]
    got = collocations(frame(spark, rows), least=least, percent=percent, most=most)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, least, percent, most)


def test_flushes_and_tiny_sketches(spark, monkeypatch):
    """Bounds of a crowded sketch are loose; sums over many flushes and shards stay exact. Workers are forked with these values."""
    rows = texts(77, 150)
    want = plain(rows, 4, 80, 500)
    for name, value in (("BLOCK", 64), ("HELD", 5), ("BUFFER", 16), ("PATTERNS", 3)):
        monkeypatch.setattr(module, name, value)
    got = [r for b in module._texts(iter([])) for r in b]
    assert got == []
    bits = module._heavy(module.Workspace(spark, "t"), spark.createDataFrame([(0, bytearray(b"\1\0"), bytearray(b"\3\0\0\0"))] * 2, "block int, offsets binary, counts binary"), 5, 2 * module.SPAN)
    assert bits.nonzero()[0].tolist() == [0] and bits[0] == 2
    assert sorted(tuple(r) for r in collocations(frame(spark, rows, 6), least=4, most=500).collect()) == want


def test_very_long_text(spark):
    rng = random.Random(5)
    rows = [("en", " ".join(rng.choices("abcdefgh", k=60000))), ("en", ". ".join(["some long words go here"] * 20000))]
    assert sorted(tuple(r) for r in collocations(frame(spark, rows), least=30, most=300).collect()) == plain(rows, 30, 80, 300)


def test_counts_saturate_without_loss():
    sums = module.Sums(5)
    rows = list(sums.add(module.np.array([3, 3, 70000, 3]), module.np.array([2, 9, 1, 1]))) + list(sums.flush())
    assert [(b, module.np.frombuffer(o, "u2").tolist(), module.np.frombuffer(c, "u4").tolist()) for b, o, c in rows] == [(0, [3], [5]), (1, [70000 - 65536], [1])]


def test_empty(spark):
    assert collocations(frame(spark, [])).collect() == []
    assert collocations(frame(spark, [("en", None)])).collect() == []
