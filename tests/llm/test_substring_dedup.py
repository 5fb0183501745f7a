import random

from tests.llm import brute
from vicinia.llm.substring_dedup import cut, dedup, removed, units


def test_units():
    t = "One two three four five six seven eight. Short one.\n\nNine words stand in this line of the text"
    found = {(v, t[a:b]) for v, a, b, _ in units(t, 8)}
    first, last = t.split("\n\n")
    assert found == {(0, first), (1, first.split(" Short")[0]), (0, last), (1, f"Short one.\n\n{last}")}
    a, b = units("A b c, d e f g H!", 8)[0][3], units("  a B c d E f g h", 8)[0][3]
    assert a == b


def test_the_earliest_stays(docs, words):
    passage = " ".join(f"{words(50 + i, 9)}." for i in range(7))
    rows = [(k, f"{words(k, 20)}\n{words(k + 20, 7)} {passage} {words(k + 40, 12)}") for k in range(6)] + [(9, f"{words(9, 15)}\n{passage}"), (10, None), (11, ""), (None, passage)]
    df = docs(rows)
    found = removed(df).collect()
    assert {r.id for r in found} == {*range(6), 9} and {r.kept_id for r in found} == {None}
    texts = {k: t for k, t in rows}
    assert all(texts[r.id][r.begin : r.end].strip() and texts[r.id][r.begin : r.end] in passage for r in found if r.level == 1)
    out = dedup(df)
    assert out.columns == [*df.columns, "removed_spans"]
    left = {r.doc_id: r for r in out.collect()}
    assert left[None].text == passage and left[10].text is None and left[11].text == "" and left[9].text.strip() == words(9, 15)
    assert all(left[k].text.startswith(words(k, 20)) and left[k].text.endswith(words(k + 40, 12)) for k in range(6))


def test_clean_and_repeated_rows_stay(docs, words):
    rows = [(k, words(k, 60)) for k in range(20)] + [(3, words(3, 60))]
    assert removed(docs(rows)).collect() == []


def test_cut():
    assert cut("ab\ncd\nef", [(3, 5)]) == "ab\nef" and cut("abcdef", [(1, 3), (2, 4)]) == "aef" and cut("ab\ncd\nef", [(0, 2), (2, 5)]) == "ef" and cut("ab", []) == "ab"


def test_empty(docs):
    assert removed(docs([])).collect() == [] and dedup(docs([])).collect() == []


def test_equals_brute_force(docs, words):
    rng = random.Random(6)
    lines = [words(k, rng.choice((1, 4, 9, 12))) for k in range(25)] + ["One two three four five six seven eight. " + words(k, 10) + "! And so." for k in range(6)] + ["---", "...", "A. B. C.", " lead, " + words(3, 9), ""]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randrange(9)))) for k in range(95)] + [(100, None), (101, ""), (None, lines[3]), (7, lines[4]), (102, words(8, 30_000))]
    got = {(r.id, r.begin, r.end) for r in removed(docs(rows)).collect()}
    assert got == brute.repeated_units(rows) and len(got) > 100


def test_a_very_long_text_takes_linear_steps(docs, words):
    parts = [words(k, 3) + "." for k in range(1500)]
    long = " ".join(parts * 40)  # 60,000 sentences, 1,500 of them different
    rows = [(1, " ".join(parts)), (2, long)]
    left = {r.doc_id: r.text for r in dedup(docs(rows)).collect()}
    assert left[1] == rows[0][1] and left[2].strip() == ""
