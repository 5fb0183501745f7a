"""The pipeline against a plain version of its stages, over the smallest tables."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
import pytest

from tests.llm import brute, test_line_pairs, test_near_copies

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def read(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returns, written and read again."""
    from vicinia.llm.common import Workspace

    ws, docs, out = Workspace(spark, "test-pipeline"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = ws.save(stage(spark, docs, SF), str(k))
        out.append(docs)
    return [sorted((r.asDict() for r in d.collect()), key=str) for d in out]


def rows(stage):
    return sorted((r["doc_id"], r["text"]) for r in stage)


def test_columns_and_lengths(stages):
    for stage in stages[:4]:
        assert list(stage[0]) == ["doc_id", "text", "lang", "source", "n_chars"]
        assert all(r["n_chars"] == len(r["text"]) for r in stage)


def test_quality(spark, stages):
    from vicinia.llm import quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = [(r["doc_id"], r["text"]) for r in read("documents") if model.vote(quality.terms(r["text"].encode())[None])[0] >= 0.5]
    assert rows(stages[0]) == sorted(want)
    labels = {r["doc_id"]: r["quality"] for r in read("labels")}
    kept = {k for k, _ in want}
    assert np.mean([k in kept for k, q in labels.items() if q]) > 0.97


def test_line_dedup(stages):
    """Every pair of neighbouring lines that an earlier place holds goes, and a text of which nothing is left."""
    before = rows(stages[0])
    want = [(k, t) for (k, own), t in zip(before, test_line_pairs.brute(before), strict=True) if t == own or t.strip()]
    assert rows(stages[1]) == want


def test_near_dedup(stages):
    """One document of each component at an exact five-word similarity of 0.8 stays."""
    want = test_near_copies.brute_kept(rows(stages[1]))
    assert rows(stages[2]) == [(k, t) for _, k, t in want]


def test_decontamination(stages):
    items = [r["text"] for r in read("benchmark")]
    grams = [set(brute.grams(brute.words(x))) for x in items]

    def bad(text):
        own = set(brute.grams(brute.words(text)))
        return any(own & g and brute.contamination(text, x) >= 0.8 for x, g in zip(items, grams, strict=True))

    assert rows(stages[3]) == [r for r in rows(stages[2]) if not bad(r[1])]


def test_packing(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for k, t in rows(stages[3]):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want |= {(k, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in stages[4]} == want
    by = defaultdict(list)
    for r in stages[4]:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in by.values():
        assert [o for o, _ in sorted(x)] == np.cumsum([0, *(n for _, n in sorted(x))]).tolist()[:-1] and sum(n for _, n in x) <= 1024
    assert len(by) <= -(-sum(r["length"] for r in stages[4]) // 1024) + 1


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], r["sequence_id"], r["offset"])
    assert sorted(map(key, (r.asDict() for r in got))) == sorted(map(key, stages[4]))
