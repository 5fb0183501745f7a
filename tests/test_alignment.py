import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from vicinia.operators.alignment import Scoring, aligned, alignment_distance, alignment_distances, resolve, string_distance
from vicinia.operators.pairs import condensed, listed, pairwise
from vicinia.sources.matrices import checked, load_matrix, named_matrix, parse_matrix, score

LETTERS = "ACDE*"
MATRIX = {a + b: (5.0 if a == b else -1.0 - abs(i - j)) for i, a in enumerate(LETTERS) for j, b in enumerate(LETTERS) if i <= j}


def best(u, v, by):
    """The best score over all alignments, by three mutually recursive cases."""

    @lru_cache(None)
    def f(i, j, state):
        if i == 0 and j == 0:
            return 0.0 if state == "m" else float("-inf")
        out = float("-inf")
        if state == "m" and i and j:
            out = by.pair(u[i - 1], v[j - 1]) + max(f(i - 1, j - 1, s) for s in "mxy")
        if state == "x" and i:
            out = max(f(i - 1, j, s) - (by.gap_extend if s == "x" else by.gap_open) for s in "mxy")
        if state == "y" and j:
            out = max(f(i, j - 1, s) - (by.gap_extend if s == "y" else by.gap_open) for s in "mxy")
        return out

    return max(f(len(u), len(v), s) for s in "mxy")


def strings(seed, n=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(9))) for _ in range(n)]


@pytest.mark.parametrize("by", [Scoring(), Scoring(None, 2, 0.5), Scoring(MATRIX, 3, 1), Scoring(MATRIX, 1, 1)])
def test_scores_are_the_best(by):
    for u, v in zip(strings(1), strings(2), strict=True):
        assert abs(aligned(u, v, by)[0] - best(u, v, by)) < 1e-9


def plain(u, v, by, charge=0.0, greedy=False):
    """Score and length by full tables of (objective, score, length), filled cell by cell."""
    low = float("-inf")
    key = (lambda c: c[1] / c[2]) if greedy else (lambda c: c[0])
    more = lambda c, x, fee=0.0: (c[0] + x - fee, c[1] + x, c[2] + 1)
    gap = lambda n: (-by.gap_open - (n - 1) * by.gap_extend,) * 2 + (n,)
    none, mid, lo, up = (low, low, 1), {}, {}, {}
    for i in range(len(u) + 1):
        for j in range(len(v) + 1):
            if not i or not j:
                mid[i, j] = gap(i + j) if i or j else (0.0, 0.0, 0)
                lo[i, j], up[i, j] = gap(i) if i and not j else none, gap(j) if j and not i else none
                continue
            opened, longer = more(mid[i - 1, j], -by.gap_open), more(lo[i - 1, j], -by.gap_extend)
            lo[i, j] = opened if key(opened) > key(longer) else longer
            opened, longer = more(mid[i, j - 1], -by.gap_open), more(up[i, j - 1], -by.gap_extend)
            up[i, j] = opened if key(opened) > key(longer) else longer
            across = more(mid[i - 1, j - 1], by.pair(u[i - 1], v[j - 1]), charge)
            if key(across) > key(lo[i, j]) and key(across) > key(up[i, j]):
                mid[i, j] = across
            else:
                mid[i, j] = lo[i, j] if key(lo[i, j]) > key(up[i, j]) else up[i, j]
    return mid[len(u), len(v)][1:]


@pytest.mark.parametrize("by", [Scoring(), Scoring(None, 2, 0.5), Scoring(MATRIX, 3, 1), Scoring(MATRIX, 1, 1)])
def test_ties_and_normalised_distances_equal_plain_tables(by):
    pairs = [p for p in zip(strings(11, 300), strings(12, 300), strict=True) if p[0] or p[1]]
    for charge, greedy in ((0.0, False), (0.4, False), (0.0, True)):
        for u, v in pairs:
            assert aligned(u, v, by, charge, greedy) == pytest.approx(plain(u, v, by, charge, greedy))
    got = alignment_distances(pairs, by, normalized=True)
    for (u, v), d in zip(pairs, got, strict=True):
        most = max(by.itself(u), by.itself(v))
        score, length = plain(u, v, by, greedy=True)
        ratio, before = (most - score) / length, None
        while before is None or abs(ratio - before) >= 1e-7:
            score, length = plain(u, v, by, ratio)
            before, ratio = ratio, (most - score) / length
        assert abs(ratio - d) < 1e-9


def test_strings_in_pairs(spark):
    df = spark.createDataFrame(list(enumerate(["kitten", "sitting", "mitten", ""])), "id long, vec string")
    got = {(r.id_a, r.id_b): r.distance for r in condensed(df, "levenshtein", gap_open=1, gap_extend=1).collect()}
    assert got == {(0, 1): 3, (0, 2): 1, (0, 3): 6, (1, 2): 3, (1, 3): 7, (2, 3): 6}
    assert {(r.id_a, r.id_b): r.distance for r in pairwise(df, df, "edit", normalized=True).collect()}[0, 0] == 0
    one = spark.createDataFrame([(0, 3)], "id_a long, id_b long")
    assert listed(one, df, df, "edit", gap_open=2.0).first().distance == 2 + 5


def test_edit_distance(spark):
    pairs = [*zip(strings(3), strings(4), strict=True), ("", ""), ("kitten", "sitting")]
    df = spark.createDataFrame([*pairs, (None, "a")], "u string, v string")
    fast, slow = string_distance("edit", "u", "v"), string_distance("levenshtein", "u", "v", normalized=True)
    for r in df.select("u", "v", fast.alias("d"), slow.alias("n")).collect():
        if r.u is None:
            assert r.d is None and r.n is None
        else:
            assert r.d == alignment_distance(r.u, r.v, Scoring()) and 0 <= r.n <= 1


def test_normalised_properties():
    for by in (Scoring(), Scoring(MATRIX, 3, 1)):
        for u, v in zip(strings(5), strings(6), strict=True):
            d = alignment_distance(u, v, by, normalized=True)
            assert d >= 0 and abs(d - alignment_distance(v, u, by, normalized=True)) < 1e-6
            if u == v:
                assert d == 0
    assert alignment_distance("", "", Scoring(), normalized=True) == 0
    assert alignment_distance("", "ACD", Scoring(MATRIX, 10, 1)) == 15 + 12


def test_user_matrix(spark):
    df = spark.createDataFrame([("ACD", "AED")], "u string, v string")
    got = df.select(string_distance("Needleman-Wunsch", "u", "v", mat=MATRIX, gap_open=10).alias("d")).first().d
    assert got == 15 - (5 - 3 + 5)
    with pytest.raises(Exception, match="KeyError"):
        spark.createDataFrame([("Q", "A")], "u string, v string").select(string_distance("nw", "u", "v", mat=MATRIX)).collect()
    with pytest.raises(ValueError, match="needs a score matrix"):
        string_distance("nw", F.col("u"), F.col("v"))
    with pytest.raises(ValueError, match="takes its scores from a table"):
        string_distance("blosum62", "u", "v")
    with pytest.raises(ValueError, match="unknown string metric"):
        resolve("soundex")


def test_matrix_files(tmp_path):
    text = "# a comment\n   A  C\nA  4 -1  # trailing\nC -1  9\n"
    (tmp_path / "BLOSUM62.txt").write_text(text)
    want = {"AA": 4.0, "AC": -1.0, "CA": -1.0, "CC": 9.0}
    assert load_matrix(tmp_path / "BLOSUM62.txt") == parse_matrix(text.splitlines()) == named_matrix("blosum", tmp_path) == want
    assert score({"AC": 1.0}, "C", "A") == 1.0
    for bad in ({}, {"ABC": 1}, {"AB": 1, "BA": 1.0}, {"AB": "x"}, [1]):
        with pytest.raises(ValueError):
            checked(bad)
    with pytest.raises(ValueError, match="no table"):
        named_matrix("pam250", tmp_path)
    with pytest.raises(KeyError):
        score({"AC": 1.0}, "A", "D")
