"""Texts leave op3's workers in small batches, whatever the batches they came in."""

import pyarrow as pa

from vicinia.llm import suffix_dedup


def test_packed_texts_leave_in_parts(monkeypatch, words):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 2000)
    texts = [None, "", *(words(k, 20 * (k % 7)) for k in range(200)), words(9, 5000), None]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array([-k for k in range(len(texts))])], ["key", "text", "id"])
    out = list(suffix_dedup.pack_rows(iter([rows, rows.slice(0, 0), rows.slice(5)])))
    got = [(k, suffix_dedup.unpacked(d).decode(), i) for b in out for k, d, i in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert got == [(k, t or "", -k) for k, t in [*enumerate(texts), *list(enumerate(texts))[5:]]]
    assert max(sum(map(len, b.column(1).to_pylist()[:-1])) for b in out) <= 2000


def test_parts_of_texts_leave_in_parts(monkeypatch, words):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 2000)
    texts = [words(k, 60).encode() for k in range(50)]
    listed = [[{"gram": k, "at": (40 + j) << 16 | 20 << 8 | 10} for j in range(k % 9)] for k in range(50)]
    kind = pa.list_(pa.struct([("gram", pa.int64()), ("at", pa.int64())]))
    rows = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([suffix_dedup.packed(t) for t in texts]), pa.array(listed, kind)], ["key", "data", "listed"])
    out = list(suffix_dedup.part_rows(100)(iter([rows])))
    got = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert got == [(k, k, x["at"], texts[k][20 + j : 130 + j]) for k in range(50) for j, x in enumerate(listed[k])]
    assert len(out) > 5 and max(b.num_rows for b in out) <= 30
