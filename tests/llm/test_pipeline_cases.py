"""The pipeline's defined cases, stage after stage: nulls, ties, repeated rows, long texts, clashing names, empty tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def good(spark):
    """Texts that the classifier accepts, without lines in common."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, seen = [], set()
    for r in sorted(corpus_pipeline.quality_stage(spark, docs, SF).collect(), key=lambda r: r.doc_id):
        lines = set(r.text.split("\n"))
        if r.lang == "en" and 60 < len(r.text.split()) < 400 and not lines & seen:
            seen |= lines
            out.append(r.text)
    return out[:12]


def stages(spark, docs, first=1, last=4):
    """What is left after each stage, written and read again as the next one's input."""
    from vicinia.llm.common import Workspace

    ws, out = Workspace(spark, "cases"), []
    for k in range(first, last + 1):
        docs = ws.save(corpus_pipeline.STAGES[k][1](spark, docs, SF), str(k))
        out.append(docs)
    return out


def test_rows_and_columns_through_all_stages(spark, docs, good):
    long = "\n".join(f"Line {k} of a very long text without end." for k in range(30_000))
    rows = [(k, t) for k, t in enumerate(good)] + [(100, good[0]), (110, good[2].replace("\n", " ")), (111, good[2].replace("\n", " ") + " More."), (5, good[5]), (None, good[6]), (200, None), (201, ""), (202, long), (203, "one line\nanother line"), (204, "x\none line\nanother line\ny")]
    df = docs(rows).withColumn("_emptied", F.lit("x")).withColumn("removed_spans", F.lit("x")).withColumn("linked", F.lit("x"))
    assert corpus_pipeline.STAGES[0][1](spark, df, SF).columns == df.columns
    lines, near, clean, packed = stages(spark, df)
    assert lines.columns == near.columns == clean.columns == df.columns
    left = Counter((r.doc_id, r.text) for r in lines.collect())
    assert (100, good[0]) not in left and left[200, None] == 1 and left[201, ""] == 1 and left[202, long] == 1
    assert (204, "x\ny") in left and all(r.n_chars == (None if r.text is None else len(r.text)) for r in lines.collect())
    kept = [r.doc_id for r in near.collect()]
    assert 200 in kept and 201 not in kept and {0, 2} <= set(kept) and not {110, 111} & set(kept) and len(kept) == len(set(kept))
    assert {r.doc_id for r in clean.collect()} <= set(kept)
    pieces = packed.collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in clean.collect()} and max(r.piece for r in pieces if r.doc_id == 202) > 50
    assert [r.length for r in pieces if r.doc_id == 200] == [1]


def test_empty_tables(spark, docs):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs([]), SF)
        assert out.count() == 0 and (k == 4 or out.columns == docs([]).columns)
