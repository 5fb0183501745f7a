import pytest

from tests.llm import brute
from vicinia.llm.decontamination import Items, clean, matches


@pytest.fixture
def items(spark, words):
    rows = [(k, words(1000 + k, 20 + 3 * k)) for k in range(8)] + [(20, words(2000, 3)), (21, None), (22, ""), (23, "a b c d e f a b c d e f a b c d e f")]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


def case(items, words):
    rows = [(k, words(k, 100)) for k in range(15)]
    for k, (i, t) in enumerate(items[:9]):
        w = t.split()
        rows.append((100 + i, f"{words(k, 30)} {t} {words(k + 50, 30)}"))
        rows.append((200 + i, f"{words(k, 30)}\n{', '.join(w).upper()}!\n{words(k + 50, 5)}"))
        rows.append((300 + i, " ".join([*words(k, 12).split(), *w[:-1], "changed", *words(k + 9, 9).split()])))
        rows.append((400 + i, " ".join([*w[: len(w) // 2], "changed", *w[len(w) // 2 :]])))
        rows.append((500 + i, " ".join(w[: len(w) // 2])))
    return [*rows, (900, "x a b c d e f a b c d e f a b c d e f y"), (901, None), (902, ""), (None, items[0][1]), (100, "repeated id " + items[1][1])]


def test_equals_brute_force(docs, items, words):
    rows = case(items[0], words)
    want = sorted((str(k), i, round(s, 9)) for k, t in rows for i, x in items[0] if (s := brute.contamination(t, x)) >= 0.8)
    got = matches(docs(rows), items[1]).collect()
    assert sorted((str(r.id), r["item"], round(r.similarity, 9)) for r in got) == want
    texts = dict(rows)
    for r in got:
        if r.similarity == 1 and r.id != 100:
            assert brute.words(texts[r.id][r.begin : r.end]) == brute.words(dict(items[0])[r["item"]])
    many = matches(docs(rows), items[1], item_bytes=300).collect()
    assert sorted(map(repr, many)) == sorted(map(repr, got))


def test_clean_documents_stay(docs, items, words):
    rows = case(items[0], words)
    df = docs(rows)
    out = clean(df, items[1])
    assert out.columns == df.columns
    want = sorted((str(k), t or "") for k, t in rows if all(brute.contamination(t, x) < 0.8 for _, x in items[0]))
    assert sorted((str(r.doc_id), r.text or "") for r in out.collect()) == want


def test_index_finds_all_within_the_radius(words):
    import random

    import numpy as np

    known = Items([0, 1, 2], [words(k, 30) for k in range(3)], 24)
    rng = random.Random(1)
    for _ in range(200):
        f = int(known.prints[1])
        for b in rng.sample(range(64), rng.randrange(30)):
            f ^= 1 << b
        window, item = known.near(np.array([0, f], np.uint64), [0, 1, 2])
        assert set(zip(window.tolist(), item.tolist(), strict=True)) == {(w, k) for w, x in enumerate((0, f)) for k, p in enumerate(known.prints) if (x ^ int(p)).bit_count() <= 24}


def test_recall_of_the_default_radius(words):
    """Windows edited down to a similarity of 0.8 or more lie within the radius."""
    import random

    rng, met = random.Random(3), 0
    for seed in range(40):
        item = words(seed, 18 + seed)
        known = Items([0], [item], 23)
        for _ in range(60):
            w = item.split()
            for at in rng.sample(range(len(w)), rng.choice((1, 1, 2))):
                w[at] = f"new{rng.randrange(10**9)}"
            if brute.contamination(" ".join(w), item) >= 0.8:
                met += 1
                assert [m[0] for m in known.matches(" ".join(w), 0.8)] == [0]
    assert met > 250


def test_short_texts_very_long_ones_and_ids_of_any_kind(spark, docs, words):
    item = words(7, 20)
    rows = [(1, " ".join(item.split()[:19])), (2, " ".join(item.split()[:12])), (3, f"{words(1, 200_000)} {item} {words(2, 10_000)}"), (4, "x" * 3_000_000 + " " + item)]
    for kind, key in (("string", "a"), ("double", 1.5), ("date", __import__("datetime").date(2020, 1, 2))):
        got = matches(docs(rows), spark.createDataFrame([(key, item)], f"item_id {kind}, text string")).collect()
        assert {(r.id, r["item"]) for r in got} == {(1, key), (3, key), (4, key)}
    assert [round(r.similarity, 4) for r in got if r.id == 1] == [round(15 / 16, 4)]


def test_empty(docs, items):
    none = items[1].where("false")
    assert matches(docs([]), items[1]).collect() == [] and matches(docs([(1, "a b c d e f")]), none).collect() == []
    assert clean(docs([(1, None)]), none).count() == 1
