import random
import zlib
from collections import Counter, defaultdict

from vicinia.llm.sharding import level_run, shard


def one_by_one(loads, size, count):
    loads, out = list(loads), [0] * len(loads)
    for _ in range(count):
        i = min(range(len(loads)), key=lambda k: (loads[k], k))
        loads[i] += size
        out[i] += 1
    return out


def test_a_run_is_dealt_as_one_by_one():
    rng = random.Random(1)
    for _ in range(300):
        loads = [rng.randrange(60) for _ in range(rng.randrange(1, 7))]
        size, count = rng.randrange(1, 12), rng.randrange(0, 120)
        assert level_run(loads, size, count) == one_by_one(loads, size, count)


def brute(rows, shards):
    groups = defaultdict(int)
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 1
    loads, home = [0] * shards, {}
    for t, w in sorted(groups.items(), key=lambda x: -x[1]):
        i = min(range(shards), key=lambda k: (loads[k], k))
        loads[i] += w
        home[t] = i
    return sorted(loads)


def test_loads_groups_and_slots(spark, docs, words):
    rows = [(k, words(k % 37 if k % 3 else 5, 3 + k % 11)) for k in range(400)] + [(400, None), (401, ""), (None, "null id"), (7, words(7, 10)), (7, words(7, 10))]
    out = shard(docs(rows), shards=5).collect()
    assert Counter(r.doc_id for r in out) == Counter(k for k, _ in rows)
    loads, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    texts = defaultdict(set)
    for k, t in rows:
        texts[k].add((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())))
    for r in out:
        assert (r["size"], r.text_crc32) in texts[r.doc_id]
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        homes[r["size"], r.text_crc32].add(r.shard)
    assert sorted(loads[i] for i in range(5)) == brute(rows, 5)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in homes.values())


def test_empty(docs):
    assert shard(docs([])).collect() == []


def test_bands_of_sizes_give_the_same_schedule(docs, words, monkeypatch):
    from vicinia.llm import sharding

    rows = [(k, "x" * (k * k % 97)) for k in range(150)]
    whole = sorted(map(tuple, shard(docs(rows), shards=5).collect()))
    monkeypatch.setattr(sharding, "BAND", 7)
    assert sorted(map(tuple, shard(docs(rows), shards=5).collect())) == whole


def test_a_very_long_text_is_one_group(docs):
    out = {r.doc_id: r for r in shard(docs([(1, "x" * 2_000_000), *((k, f"t{k}") for k in range(2, 30))]), shards=3).collect()}
    assert out[1]["size"] == 2_000_001 and [k for k, r in out.items() if r.shard == out[1].shard] == [1]
