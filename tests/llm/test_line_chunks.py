"""Line dedup by content-defined chunks and, for what they leave, pairs."""

from collections import Counter

from tests.llm import test_line_pairs
from vicinia.llm.common import Workspace
from vicinia.llm.line_dedup import dedup, filled_chunks, repeated_lines


def case(words):
    rows = test_line_pairs.case(words)
    long = "\n\n".join(words(900 + i, 7) for i in range(40))
    return rows + [(50, long), (51, "x\n" + long.replace("\n\n", "\n") + "\ny"), (52, long + "\n\n" + long), (None, "|a\n b\n|c"), (53, "|a\n\n b\n|c\n")]


def test_chunks_hold_each_line_that_is_not_blank(spark, words):
    rows = case(words)
    got = filled_chunks(spark.createDataFrame(rows, "id long, text string").where("id >= 50")).collect()
    texts = dict(rows)
    for r in got:
        own = texts[r.id].split("\n")[r.chunk : r.chunk + r.n_lines]
        assert own[0].strip() and own[-1].strip() and "\n".join(x for x in own if x.strip()) == r.part
    assert len(got) >= 3 * 8


def test_chunks_then_pairs_equal_all_pairs(docs, words):
    rows = case(words)
    df = docs(rows)
    want = test_line_pairs.brute(rows)
    got = dedup(df, flag="flag", both=True).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((k, w) for (k, _), w in zip(rows, want, strict=True))


def test_chunks_find_most_of_a_long_copy(spark, docs, words):
    chunks, rest = repeated_lines(Workspace(spark, "test-lines"), docs(case(words)))
    by_chunks = {(r.id, n) for r in chunks.collect() for n in range(r.chunk, r.chunk + r.n_lines)}
    assert len([n for k, n in by_chunks if k == 51]) > 20
    assert not {(r.id, r.chunk) for r in rest.collect()} & {(r.id, n) for r in chunks.collect() for n in range(r.chunk, r.chunk + r.n_lines - 1)}


def test_the_pipeline_takes_chunks(spark, docs, words, monkeypatch):
    import corpus_pipeline
    from vicinia.llm import line_dedup

    seen = []
    monkeypatch.setattr(line_dedup, "chunked", lambda *a, f=line_dedup.chunked: seen.append(a) or f(*a))
    corpus_pipeline.line_dedup_stage(spark, docs(case(words)), "")
    assert seen
