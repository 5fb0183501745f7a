import random

import xxhash

from vicinia.llm.simhash import components, fingerprint, links, near_duplicates, representatives
from vicinia.llm.common import Workspace


def plain_fingerprint(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, distance=3):
    of = list(range(len(fps)))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                of[b] = a
    out = {}
    for i in range(len(fps)):
        out.setdefault(find(i), []).append(i)
    return {i: min((ids[k] for k in g if ids[k] is not None), default=None) for g in out.values() for i in g}


def test_fingerprints():
    for t in ("", " \t\n", "one", "One TWO", "a b c", "Ünï  CÖDE x y\vz q", "x " * 50, "le mot est dit et le mot est dit"):
        assert fingerprint(t.encode()) == plain_fingerprint(t)


def test_links_equal_brute_force(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(120)] + [0, 2**64 - 1]
    fps = set(base)
    for f in base:
        for n in (1, 2, 3, 4):
            for b in rng.sample(range(64), n):
                f ^= 1 << b
            fps.add(f)
    signed = [f - 2**64 if f >= 2**63 else f for f in sorted(fps)]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for distance in (1, 3):
        got = {(r.a, r.b) for r in links(df, distance).collect()}
        want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= distance}
        assert got == want


def test_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(-5, 7)]
    out = components(Workspace(spark, "test"), spark.createDataFrame(edges, "a long, b long"))
    root = {r.node: r.root for r in out.collect()}
    assert {root[i] for i in range(201)} == {-5} and {root[1000 + i] for i in range(50)} == {1000} and len(root) == 252


def case(words):
    base = words(1, 120)
    rows = [(k, words(k, 40 + k)) for k in range(2, 30)]
    rows += [(100 + k, base if k % 3 else base + " tail" * k) for k in range(12)]
    rows += [(200, None), (201, ""), (202, "  \n"), (None, base), (None, "only here without an id"), (5, words(5, 45)), (5, words(5, 45))]
    return rows


def test_components(docs, words):
    rows = case(words)
    fps = [plain_fingerprint(t) for _, t in rows]
    want = brute_components([k for k, _ in rows], fps)
    out = near_duplicates(docs(rows)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in out), key=key) == sorted(((k, f, want[i]) for i, ((k, _), f) in enumerate(zip(rows, fps, strict=True))), key=key)


def test_one_of_each_component_stays(docs, words):
    rows = case(words)
    want = brute_components([k for k, _ in rows], [plain_fingerprint(t) for _, t in rows])
    df = docs(rows)
    out = representatives(df)
    assert out.columns == df.columns
    got = [r.doc_id for r in out.collect()]
    assert sorted(x for x in got if x is not None) == sorted({x for x in want.values() if x is not None}) and got.count(None) == 1


def test_empty(docs):
    assert near_duplicates(docs([])).collect() == [] and representatives(docs([])).collect() == []
