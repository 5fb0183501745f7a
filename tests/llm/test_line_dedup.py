from collections import Counter

from pyspark.sql import functions as F

from tests.llm import brute
from vicinia.llm.line_dedup import chunked, dedup, plain, removed


def lines(words, seed, n):
    return "\n".join(words(seed * 100 + i, 6) for i in range(n))


def case(words):
    shared = lines(words, 77, 12)
    rows = [(k, lines(words, k, 5) + ("\n" + shared if k % 2 else "") + "\n" + lines(words, k + 500, 4)) for k in range(20)]
    rows += [(30, shared), (31, shared), (32, "\n\n\n\n"), (33, "\n\n\n\n"), (34, None), (35, ""), (36, "|a\n b\n|c"), (None, shared), (5, rows[5][1])]
    return rows


def test_chunks_keep_every_line(spark, words):
    for t in ("", "a", "|a\n b\n|c\n", "\n\n", lines(words, 1, 60)):
        (r,) = chunked(spark.createDataFrame([(t,)], "text string")).selectExpr("_chunks").collect()
        assert len(r[0]) == len(brute.line_chunks(t))
        got = chunked(spark.createDataFrame([(t,)], "text string")).selectExpr("explode(_chunks) as c").select(plain(F.col("c")).alias("c")).collect()
        assert "\n".join(x.c for x in got) == t


def test_equals_brute_force(docs, words):
    rows = case(words)
    want, changed = brute.line_dedup(rows)
    df = docs(rows)
    out = dedup(df, flag="flag")
    assert out.columns == [*df.columns, "flag"]
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((k, w) for (k, _), w in zip(rows, want, strict=True))
    assert sum(bool(r.flag) for r in got) == sum(i in changed and not want[i].strip() for i in range(len(rows)))
    assert {r.id for r in removed(df).collect()} == {rows[i][0] for i in changed}


def test_empty(docs):
    assert dedup(docs([])).collect() == [] and removed(docs([])).collect() == []
