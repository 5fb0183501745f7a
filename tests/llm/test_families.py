"""Families of linked sets against plain union-find, with few rounds and with labels that don't reach everything."""

import random

import numpy as np
import pytest

from vicinia.llm import families as module
from vicinia.llm.common import Workspace
from vicinia.llm.families import families


def plain(sets, pairs, percent):
    of = {k: k for k in sets}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in pairs:
        if len(sets[a] & sets[b]) * 100 >= percent * len(sets[a] | sets[b]):
            a, b = root(a), root(b)
            of[max(a, b)] = min(a, b)
    return {k: root(k) for k in sets}


def grouped(rows, sets):
    """Components of two or more nodes."""
    found = {}
    for r in rows:
        found.setdefault(r.root, set()).add(r.node)
    assert len({r.node for r in rows}) == len(rows)
    return sorted(sorted(x) for x in found.values() if len(x) > 1)


@pytest.mark.parametrize("seed, rounds", [(0, 6), (1, 6), (2, 1), (3, 2)])
def test_equals_union_find(spark, monkeypatch, seed, rounds):
    monkeypatch.setattr(module, "ROUNDS", rounds)
    rng = random.Random(seed)
    sets, shared, keys = {}, [], {}
    for f in range(12):
        base = rng.sample(range(1, 10**6), 40)
        for _ in range(rng.choice([1, 2, 5, 25])):
            node = rng.randrange(-(2**40), 2**40)
            own = set(base[: 40 - rng.randrange(0, 9)]) | {rng.randrange(10**6, 10**9) for _ in range(rng.randrange(0, 5))}
            sets[node] = own
            for key in {f, 100 + rng.randrange(3), 200 + f % 4}:
                keys.setdefault(key, []).append(node)
    for key, nodes in keys.items():
        if len(nodes) > 1:
            shared += [(key, node, len(sets[node]), len(nodes)) for node in nodes]
    # all shingles of a pair of similar sets that no key holds stay unlinked, but the prefix filter may find them: every node shares a key here
    pairs = [(a, b) for nodes in keys.values() for a in nodes for b in nodes if a < b]
    want = {}
    for k, r in plain(sets, pairs, 80).items():
        want.setdefault(r, set()).add(k)
    frame = spark.createDataFrame([(k, bytearray(np.array(sorted(x), np.uint64).tobytes())) for k, x in sets.items()], "node long, grams binary")
    got = families(Workspace(spark, "test"), spark.createDataFrame(shared, "key long, node long, n int, many long"), frame, 80).collect()
    assert grouped(got, sets) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_chain_beyond_two_steps(spark):
    """Labels cross two links a round; the rest is joined at the end."""
    rng = random.Random(4)
    order = rng.sample(range(1000), 40)
    sets = {node: np.arange(k, k + 40, dtype=np.uint64) for k, node in enumerate(order)}
    frame = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in sets.items()], "node long, grams binary")
    none = spark.createDataFrame([], "key long, node long, n int, many long")
    links = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    got = families(Workspace(spark, "test"), none, frame, 90, links).collect()
    assert {r.node for r in got} == set(order) and len({r.root for r in got}) == 1


def test_links_of_another_source(spark):
    """Candidates link by themselves if their sets are similar, and don't if they aren't or are empty."""
    a = np.arange(1, 21, dtype=np.uint64)
    sets = {1: a, 2: a[1:], 3: a[10:], 4: np.empty(0, np.uint64), 5: np.empty(0, np.uint64)}
    frame = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in sets.items()], "node long, grams binary")
    none = spark.createDataFrame([], "key long, node long, n int, many long")
    covered = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (4, 5)], "a long, b long")
    got = families(Workspace(spark, "test"), none, frame, 80, covered).collect()
    assert {(r.node, r.root) for r in got} == {(1, 1), (2, 1)}
