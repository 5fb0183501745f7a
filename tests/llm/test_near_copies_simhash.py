"""The pipeline's near-copy stage joins by SimHash and anchor covering first."""

import xxhash

import corpus_pipeline
from tests.llm.test_near_copies import brute_kept, grams
from vicinia.llm import near_copies, simhash
from vicinia.llm.common import Workspace


def hashes(text):
    return {xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams(text)}


def plain(text):
    h = hashes(text)
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def case(words):
    rows = [(k, words(k, 400, 10**6)) for k in range(12)]
    for k in range(12):
        w = rows[k][1].split()
        w[7] = "changed"  # 5 of 396 shingles
        rows.append((100 + k, " ".join(w)))
    return [*rows, (200, None), (201, "short"), (202, "Short!")]


def test_fingerprint_of_a_set(words):
    for t in ("", "one", "a b c d e f g", words(1, 500)):
        assert near_copies.of_hashes(near_copies.shingles(t.encode())) == plain(t)


def test_stage_takes_its_pairs_from_anchor_covering(spark, docs, words, monkeypatch):
    rows, met = case(words), []

    def links(fps, distance):
        met.append(simhash.links(fps, distance))
        return met[-1]

    monkeypatch.setattr(near_copies, "links", links)
    kept = corpus_pipeline.simhash_stage(spark, docs(rows), "").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in kept) == brute_kept(rows)
    fps = sorted({signed(plain(t)) for _, t in rows if t})
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert len(want) >= 6 and {(r.a, r.b) for r in met[0].collect()} == want


def test_equal_fingerprints_meet_their_first_node(spark):
    nodes = spark.createDataFrame([(5, 9, 7), (-3, 9, 7), (8, 9, 7), (2, 9, 6), (1, 9, 1 << 40 | 0xFF), (4, 0, 0)], "node long, n int, fp long")
    got = near_copies._covered(Workspace(spark, "test"), nodes).collect()
    assert {(r.a, r.b) for r in got} == {(-3, 5), (-3, 8), (-3, 2)}
