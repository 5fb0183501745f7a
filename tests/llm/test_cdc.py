import hashlib

import numpy as np

from vicinia.llm.cdc import GEAR32, boundaries, chunks, containment, edited, fingerprint, fingerprints


def test_boundaries_resist_shifts(words):
    b = words(1, 400).encode()
    a = np.frombuffer(b, np.uint8)
    one, other = set(boundaries(a)), {x - 7 for x in boundaries(np.frombuffer(b"seven b" + b, np.uint8))}
    assert len(one & other) > 0.9 * len(one)
    sizes = np.diff([0, *sorted(one)])
    assert sizes.max() <= 256 and sizes[:-1].min() >= 24 and sorted(one)[-1] == len(b)


def test_containment(words):
    a, b = chunks(words(1, 300)), chunks(words(2, 300))
    empty = chunks("")
    assert containment(a, a) == 1 and containment(a, b) < 0.1
    assert containment(empty, empty) == 1 and containment(empty, a) == 0 and containment(a, empty) == 0
    assert 0.3 < containment(a, chunks(words(1, 300)[: len(words(1, 300)) // 2])) < 0.7
    assert fingerprint(chunks("Some  TEXT\n")) == fingerprint(chunks("some text")) and fingerprint(empty) == ""
    assert len(fingerprint(a)) == 20 * len(a[0])


def plain_chunks(text):
    """{chunk: length} by one gear hash a byte."""
    b, out, at, h = b" ".join(text.encode().lower().split()), {}, 0, 0
    for i, x in enumerate(b):
        h = ((h << 1) + int(GEAR32[x])) % 2**32  # bytes before the last 32 have left the word
        size = i + 1 - at
        if size >= 24 and i + 1 < len(b) and (h < 1 << 25 if size < 64 else h < 1 << 27 or size == 256):
            out[b[at : i + 1]] = size
            at = i + 1
    if at < len(b):
        out[b[at:]] = len(b) - at
    return out


def test_chunks_and_likeness_equal_a_plain_version(words):
    texts = [words(k, 40 * k + 3) for k in range(12)] + ["a" * 2000, "é日" * 300, "x", words(5, 203) + words(6, 100)]
    for t in texts:
        want = plain_chunks(t)
        digests, lengths = chunks(t)
        assert len(digests) == len(want) and sorted(lengths.tolist()) == sorted(want.values())
        for other in texts:
            own = plain_chunks(other)
            assert abs(containment(chunks(t), chunks(other)) - sum(n for c, n in want.items() if c in own) / sum(want.values())) < 1e-12


def test_pairs_with_the_next_document(docs, words):
    rows = [(k * 5 % 101, words(k, k % 60)) for k in range(101)] + [(300, None), (301, "é" * 7), (302, words(3, 3))]
    out = {r.doc_id: r for r in fingerprints(docs(rows)).collect()}
    order = sorted(rows)
    assert len(out) == len(rows)
    for i, (k, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        changed = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        r = out[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert r.fingerprint == fingerprint(chunks(t)) and r.edited_fingerprint == fingerprint(chunks(changed))
        assert r.near_edited == containment(chunks(t), chunks(changed)) and r.near_next == containment(chunks(t), chunks(following))


def test_null_and_repeated_ids(docs):
    out = fingerprints(docs([(1, "b" * 30), (1, "b" * 30), (None, "a" * 30), (2, "c" * 30)])).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "1", "2", "None"]
    last = next(r for r in out if r.doc_id == 2)
    assert last.edited_sha256 == hashlib.sha256(("c" * 15 + "a" * 15).encode()).hexdigest()


def test_one_and_none(docs):
    (r,) = fingerprints(docs([(4, "abcd")])).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and edited("x", "yz") == "x"
    assert fingerprints(docs([])).collect() == []
