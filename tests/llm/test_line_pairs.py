"""Line dedup by pairs: short repeated passages go whole, and each line's earliest place stays."""

from collections import Counter

from vicinia.llm.line_dedup import dedup, removed


def brute(rows):
    first, gone = {}, {}
    pairs = []
    for i, (k, t) in enumerate(rows):
        lines = [(n, x) for n, x in enumerate(t.split("\n") if t is not None else []) if x.strip(" \t\r\n\f\v")]
        pairs += [((a[1], b[1]), (k is not None, k or 0, a[0]), i, range(a[0], b[0] + 1)) for a, b in zip(lines, lines[1:], strict=False)]
    for key, place, _, _ in pairs:
        first[key] = min(first.get(key, place), place)
    for key, place, i, lines in pairs:
        if first[key] != place:
            gone.setdefault(i, set()).update(lines)
    return [t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, ())) for i, (_, t) in enumerate(rows)]


def case(words):
    def lines(seed, n):
        return "\n".join(words(seed * 100 + i, 8) for i in range(n))

    rows = [(k, lines(k, 3) + "\n" + lines(70 + k % 4, 2 + k % 4) + "\n" + lines(k + 300, 2)) for k in range(16)]
    rows += [(30, "a\n\nb\nc"), (31, "x\na\n \nb\ny"), (32, "\n\n\n"), (33, "\n\n\n"), (34, None), (35, ""), (36, "z\nz\nz\nz"), (37, "one"), (38, "one"), (None, lines(71, 3))]
    return rows + [(5, rows[5][1])]


def test_every_short_passage_goes(docs, words):
    rows = case(words)
    df = docs(rows)
    want = brute(rows)
    out = dedup(df, flag="flag", pairs=True)
    assert out.columns == [*df.columns, "flag"]
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((k, w) for (k, _), w in zip(rows, want, strict=True))
    assert all(w.count("\n") == 4 for w in want[4:16])  # the passage of two to five lines is gone, the five own lines stay
    assert {r.id for r in removed(df, pairs=True).collect()} == {k for (k, t), w in zip(rows, want, strict=True) if t != w}
    lines = lambda texts: {x for t in texts for x in (t or "").split("\n") if x.strip()}
    assert lines(want) == lines(t for _, t in rows)


def test_the_query_finds_all_pairs(spark):
    from vicinia.llm import registry

    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id for r in registry.queries()["op5_line_dedup"](spark, sf).collect()}
    assert got == {k for (k, t), w in zip(rows, brute(rows), strict=True) if t != w}


def test_empty(docs):
    assert dedup(docs([]), pairs=True).collect() == [] and removed(docs([]), pairs=True).collect() == []
