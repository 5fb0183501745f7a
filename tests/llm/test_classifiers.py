import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from vicinia.llm import quality, toxicity
from vicinia.llm.labelled import training_rows

SF = "/root/testdata/sf0.01"


def held_out(k):
    return zlib.crc32(("" if k is None else str(k)).encode()) % 3 == 1


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def checked(scored, labels, label):
    rows = scored.join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", label).collect()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    pos, neg = ([r for r in out if r[label] == v] for v in (1, 0))
    rate = lambda x: np.mean([r.predicted for r in x])
    return rate(pos), rate(neg)


def test_quality_on_held_out_labels(tables):
    docs, labels = tables
    good, bad = checked(quality.score(docs, quality.fit(docs, labels)), labels, "quality")
    assert good >= 0.95 and bad <= 0.2


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    toxic, clean = checked(toxicity.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), toxicity.fit(docs, labels)), labels, "toxic")
    assert toxic >= 0.8 and clean <= 0.02


def plain_toxicity(text, weights, bias):
    none = 1.0
    for sentence in re.split(r"[.!?\n]+", text or ""):
        if sentence:
            own = set()
            for w in re.findall(r"[^\W\d_]+", sentence.lower()):
                own |= {w + "$"} | {w[:k] for k in range(3, 9) if k < len(w)}
            none *= 1 - 1 / (1 + math.exp(-bias - sum(weights.get(f, 0.0) for f in own)))
    return 1 - none


def test_toxicity_equals_a_plain_noisy_or(docs, tables):
    texts, labels = tables
    rows = [(r.doc_id, r.text) for r in texts.limit(60).collect()] + [(9000, None), (9001, ""), (9002, "One. Two!\n three? " * 4000), (5, "five"), (5, "five")]
    model = toxicity.fit(texts, labels)
    got = sorted((r.doc_id, round(r.score, 9)) for r in toxicity.score(docs(rows), model).collect())
    assert got == sorted((k, round(plain_toxicity(t, model.weights, model.bias), 9)) for k, t in rows)


def test_toxicity_is_fitted_to_the_documents():
    """The log-likelihood of document labels can't be bettered by moving a weight or the bias."""
    rng = random.Random(2)
    texts = [". ".join(" ".join(rng.choice("red green blue black white grey".split()) for _ in range(4)) for _ in range(3)) for _ in range(300)]
    labels = np.array([int("red" in t and rng.random() < 0.9 or rng.random() < 0.05) for t in texts])
    model = toxicity.train(texts, labels, apart=2.0)

    def loss(weights, bias):
        p = [min(max(plain_toxicity(t, weights, bias), 1e-12), 1 - 1e-12) for t in texts]
        return -np.mean([math.log(x if y else 1 - x) for x, y in zip(p, labels, strict=True)]) + 1.5e-5 * sum(w * w for w in weights.values())

    base = loss(model.weights, model.bias)
    assert any(f.startswith("red") for f in model.weights)
    for step in (-0.2, 0.2):
        assert loss(model.weights, model.bias + step) > base
        for f in model.weights:
            assert loss(model.weights | {f: model.weights[f] + step}, model.bias) > base - 1e-4


def test_quality_equals_plain_votes(docs, tables):
    texts, labels = tables
    model = quality.fit(texts, labels)
    rows = [(r.doc_id, r.text) for r in texts.limit(40).collect()] + [(9000, None), (9001, ""), (9002, "many words " * 30_000), (5, "five"), (5, "five")]
    got = sorted((r.doc_id, round(r.score, 4)) for r in quality.score(docs(rows), model).collect())
    want = []
    for k, t in rows:
        x = quality.terms((t or "").encode()).astype(float)
        head = x[: quality.TERMS] * model.idf
        x = np.concatenate((head / max(np.linalg.norm(head), 1e-9), model.shape_weight * x[quality.TERMS :]))
        x = x / max(np.linalg.norm(x), 1e-9) @ model.axes
        cosines = model.vectors.astype(float) @ (x / max(np.linalg.norm(x), 1e-9))
        near = sorted(range(len(cosines)), key=lambda i: (-cosines[i], i))[: model.neighbours]
        weight = [max(cosines[i], 0) ** model.sharpness for i in near]
        want.append((k, round(sum(w * model.labels[i] for w, i in zip(weight, near, strict=True)) / sum(weight), 4)))
    assert sum(abs(a[1] - b[1]) > 2e-4 for a, b in zip(got, sorted(want), strict=True)) <= 1  # a rounded cosine may pick another 15th


def test_quality_ties_and_blocks():
    """Of equal neighbours the first vote, and a row's score doesn't depend on its block."""
    model = quality.Model(np.ones(quality.TERMS, np.float32), np.eye(quality.TERMS + quality.SHAPES, dtype=np.float32)[:, :3], np.tile(np.array([[1, 0, 0]], np.float32), (40, 1)), np.array([1.0] * 10 + [0.0] * 30))
    row = np.zeros((1, quality.TERMS + quality.SHAPES), np.float32)
    row[0, 0] = 1
    assert abs(model.vote(row)[0] - 10 / 15) < 1e-12
    texts = [f"text {k} " * (k % 9) for k in range(300)]
    rng = np.random.default_rng(1)
    model = quality.train(np.stack([quality.terms(t.encode()) for t in texts]), rng.integers(0, 2, 300))
    whole = model.scores(pa.array(texts))
    for at in (0, 1, 17, 255, 256, 299):
        assert model.scores(pa.array(texts[at : at + 3])).tolist() == whole[at : at + 3].tolist()


def test_sentences_that_offend(spark, docs):
    rows = [(k, f"Fine words here number {k}. {'You utter scoundrel!' if k % 2 else 'A kind remark.'} More text follows") for k in range(120)]
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, toxic int")
    df = docs([*rows, (500, None), (501, ""), (502, "...\n!"), (None, rows[1][1]), (7, rows[7][1])])
    model = toxicity.fit(df, labels)
    out = toxicity.score(df, model).collect()
    assert len(out) == len(rows) + 5
    for r in out:
        if r.doc_id in (500, 501, 502):
            assert r.score == 0 and r.predicted == 0 and r.n_sentences == 0
        elif r.doc_id is None or r.doc_id % 2:
            text = rows[1 if r.doc_id is None else r.doc_id][1]
            assert r.predicted == 1 and [text[s.begin : s.end].strip() for s in r.offending] == ["You utter scoundrel"]
        else:
            assert r.predicted == 0 and r.offending == []


def test_noisy_or():
    p = np.array([0.1, 0.5, 0.0, 0.9])
    assert abs(toxicity.noisy_or(p) - (1 - 0.9 * 0.5 * 0.1)) < 1e-12 and toxicity.noisy_or(np.array([])) == 0


def test_training_rows_are_bounded_and_not_held_out(spark, docs):
    df = docs([(k, f"text {k}") for k in range(200)] + [(None, "x"), (3, "again")])
    even = next(k for k in range(0, 200, 2) if not held_out(k))
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)] + [(None, 1), (5, None), (even, 1)], "doc_id long, quality int")
    rows = training_rows(df, labels, "quality", 1000).collect()
    assert {int(r.text.split()[1]) for r in rows if r.text.startswith("text")} == {k for k in range(200) if not held_out(k)}
    assert next(r.label for r in rows if r.text == f"text {even}") == 1
    assert training_rows(df, labels, "quality", 20).count() <= 21


def test_votes_equal_brute_force():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "###", "$$$"], 30)).encode() for _ in range(60)]
    rows, labels = np.stack([quality.terms(t) for t in texts]), rng.integers(0, 2, 60)
    model = quality.train(rows, labels, rank=8)
    got = model.vote(rows[:10])
    z = quality.unit(model.weighted(rows[:10]) @ model.axes)
    for v, q in zip(got, z, strict=True):
        near = sorted(((float(q @ x), int(y)) for x, y in zip(model.vectors, labels, strict=True)), reverse=True)[: model.neighbours]
        weights = [max(c, 0) ** model.sharpness for c, _ in near]
        assert abs(v - sum(w * y for w, (_, y) in zip(weights, near, strict=True)) / sum(weights)) < 1e-4


def test_edge_cases(spark, docs, words):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = docs([(1, None), (2, ""), (None, "a"), (3, words(1, 5000)), (3, words(1, 5000))])
    assert [r.score for r in quality.score(df, quality.fit(df, none)).collect()] == [0.5] * 5
    assert [r.score for r in toxicity.score(df, toxicity.fit(df, none)).collect()] == [0.0] * 5
    one = spark.createDataFrame([(k, 1, 1) for k in range(10)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality.score(df, quality.fit(df, one)).collect())
    kept = quality.accepted(df, quality.fit(df, none))
    assert kept.columns == df.columns and kept.count() == 5
    assert quality.score(docs([]), quality.fit(docs([]), one)).collect() == [] and toxicity.score(docs([]), toxicity.fit(docs([]), one)).collect() == []
