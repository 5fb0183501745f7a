"""SuperMinHash near copies against all pairs, and its signatures against the walk element by element."""

import random
import re

import numpy as np
import pytest

from vicinia.llm import superminhash
from vicinia.llm.common import BASE, WordHashes, splitmix

SIZE = superminhash.SIZE
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, width=3):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def plain(rows, percent=85):
    sets, of = [grams(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = of[i], of[j]
                of = [b if x == a else x for x in of]
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[of[i]] = min(least.get(of[i], k), k)
    out = [(k, len(sets[i]), least.get(of[i]) if sets[i] else k) for i, (k, _) in enumerate(rows)]
    return sorted(((*r, r[0] == r[2]) for r in out), key=repr)


def walked(elements):
    """One set's signature, an element at a time, without stopping early."""
    out = [2**64 - 1] * SIZE
    for x in elements:
        order = list(range(SIZE))
        for j in range(SIZE):
            u = int(splitmix(np.array([(int(x) + BASE * (j + 1)) % 2**64], np.uint64))[0])
            k = j + ((u >> 32) * (SIZE - j) >> 32)
            order[j], order[k] = order[k], order[j]
            out[order[j]] = min(out[order[j]], j << 32 | u & 2**32 - 1)
    return out


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_signatures_equal_the_whole_walk(monkeypatch, block):
    monkeypatch.setattr(superminhash, "BLOCK", block)
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 2, 0, 30, 90)]
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    got = superminhash.signatures(np.concatenate(sets), of, len(sets))
    assert [got[k].tolist() for k in range(len(sets))] == [walked(x) for x in sets]


def test_agreement_is_the_similarity():
    rng = np.random.default_rng(2)
    pool = [rng.integers(0, 2**63, 300, dtype=np.uint64) for _ in range(60)]
    both = [x for p in pool for x in (p[:270], p[30:])]  # 240 of 300 in common
    got = superminhash.signatures(np.concatenate(both), np.repeat(np.arange(120), 270), 120).reshape(60, 2, SIZE)
    assert abs((got[:, 0] == got[:, 1]).mean() - 0.8) < 0.01


def test_shingles(words):
    for t in ("", "one", "one TWO", "a b  c\td", "a.b . . . .", words(1, 200)):
        assert len(superminhash.shingles(t.encode(), 3, WordHashes(most=10))) == len(grams(t))


def case(words):
    rng = random.Random(9)
    rows = [(k, words(k, rng.choice([1, 2, 3, 5, 40, 90, 200]), 300)) for k in range(40)]
    for k in range(40):
        w = rows[k][1].split()
        for at in rng.sample(range(len(w)), min(len(w), k % 5)):
            w[at] = f"new{k}"
        rows.append((100 + k, " ".join(w).upper()))
    family = words(77, 120).split()
    rows += [(300 + k, " ".join([*family[: 120 - k], *(f"own{k}-{i}" for i in range(k))])) for k in range(12)]
    rows += [(400 + k, words(77, 120) + f" end{k}") for k in range(30)]
    return rows + [(-5, rows[3][1]), (500, None), (501, ""), (502, " \t\n"), (503, "x\x1cy"), (504, "X\x1cY"), (None, rows[4][1]), (None, None), (None, "its own text alone"), (505, rows[5][1]), (505, "another text of the id"), (506, words(5, 50000))]


def test_equals_all_pairs(spark, docs, words):
    rows = case(words)
    got = superminhash.near_duplicates(docs(rows))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)


def test_exact_at_the_threshold(spark):
    """17 of 20 shingles in common link, 16 of 19 don't."""
    a = [f"a{k}" for k in range(20)]
    rows = [(1, " ".join(a)), (2, " ".join(a[:-1])), (3, " ".join(f"b{k}" for k in range(21))), (4, " ".join(f"b{k}" for k in range(18)))]
    rows += [(5, " ".join(f"c{k}" for k in range(22))), (6, " ".join(f"c{k}" for k in range(19)))]  # 17 of 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in superminhash.near_duplicates(df).collect()) == plain(rows)


def test_empty(spark, docs):
    assert superminhash.near_duplicates(docs([])).collect() == []
    assert [tuple(r) for r in superminhash.near_duplicates(docs([(3, None)])).collect()] == [(3, 0, 3, True)]
