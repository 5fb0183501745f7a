"""Substring dedup of short lines, of runs across lines, and of paragraphs that are broken into other lines."""

from vicinia.llm.substring_dedup import dedup, removed, units


def test_short_lines_count_in_runs_alone():
    t = "One.\n---\n \nTwo words\nand more\n\nlast"
    assert {(v, t[a:b]) for v, a, b, _ in units(t, 4)} == {(2, "Two words\nand more"), (1, "One.\n---\n \nTwo words\nand more"), (1, "Two words\nand more\n\nlast")}
    assert units(t, 8) == [] and units("---\n***", 1) == []


def test_stock_lines_stay_and_rewrapped_paragraphs_go(docs, words):
    p = words(1, 60).split()
    wide, narrow = (" ".join(p[:30]) + "\n" + " ".join(p[30:]), "\n".join(" ".join(p[k : k + 7]) for k in range(0, 60, 7)))
    rows = [(k, f"{words(k + 10, 12)}\nAll rights reserved.\n\n{words(k + 30, 3)}") for k in range(5)] + [(7, wide), (8, f"{words(90, 9)}\n\n{narrow}\n\n{words(91, 9)}")]
    left = {r.doc_id: r.text for r in dedup(docs(rows)).collect()}
    assert all(left[k] == rows[k][1] for k in range(5))
    assert left[7] == wide and left[8].split() == f"{words(90, 9)} {words(91, 9)}".split()
    assert {r.id for r in removed(docs(rows)).collect()} == {8}


def test_a_passage_of_short_lines_goes_whole(docs, words):
    passage = "\n".join(words(40 + k, 3) for k in range(7))
    rows = [(k, f"{words(k, 20)}\n{passage}\n\n{words(k + 20, 20)}") for k in range(4)]
    left = {r.doc_id: r.text for r in dedup(docs(rows)).collect()}
    assert left[0] == rows[0][1] and all(left[k] == f"{words(k, 20)}\n\n{words(k + 20, 20)}" for k in range(1, 4))


def test_the_earliest_place_of_each_piece_stays(docs):
    rows = [(1, "\n".join(["la la"] * 30)), (2, "x y\n" * 20 + "la la"), (3, None)]
    left = {r.doc_id: r.text for r in dedup(docs(rows)).collect()}
    assert left[1].split("\n")[0] == "la la" and left[2].startswith("x y") and "la la" in left[2] and left[3] is None


def test_a_unit_is_no_copy_of_what_it_lies_in(docs, words):
    line = words(3, 16)
    rows = [(1, f"---\n{words(4, 15)}\n***"), (2, f"  {line}. -\n---\n"), (3, None), (4, f"---\n\n {words(5, 18)} "), (5, "İ. " * 20 + words(6, 9))]
    assert {r.id for r in removed(docs(rows)).collect()} <= {5}
