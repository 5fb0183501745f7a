import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from vicinia.llm.packing import best_fit, pack, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def whole(text):
    return tokens(PATH).whole.encode(text, add_special_tokens=False).ids


def test_chunks_give_the_tokenizers_ids():
    rng = random.Random(2)
    parts = [" ", " ", "\n", "a", "Bc", "'", "s", "'ll", "9", "12", ".", "é", "\t", "…", "日本", "😀", "_", " ", "\x00", "<|endoftext|>", "word"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(10)))
        assert np.frombuffer(tokens(PATH).of(t), "<u4").tolist() == whole(t), repr(t)


def placed(runs, lengths):
    out, (first, seq, per, offset, length) = [], runs.T
    for pos, n in enumerate(lengths):
        r = int(np.searchsorted(first, pos, side="right")) - 1
        k = pos - first[r]
        assert length[r] == n
        out.append((int(seq[r] + k // per[r]), int(offset[r] + k % per[r] * n), n))
    return out


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits, key=lambda i: gaps[i])] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(12))
def test_runs_pack_like_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.randrange(1, 101) if seed % 2 else min(rng.randrange(1, 101), rng.randrange(1, 101)) for _ in range(400)), reverse=True)
    sizes = sorted(set(lengths), reverse=True)
    at = placed(best_fit(sizes, [lengths.count(n) for n in sizes], 100), lengths)
    by = defaultdict(list)
    for s, o, n in at:
        by[s].append((o, n))
    for x in by.values():
        end = 0
        for o, n in sorted(x):
            assert o == end
            end += n
        assert end <= 100
    assert sorted(by) == list(range(len(by)))
    assert len(by) <= best_fit_decreasing(lengths, 100) + 1


def test_pieces(docs, words):
    rows = [(k, words(k, 10 + 37 * k % 900)) for k in range(60)] + [(60, None), (61, ""), (62, words(62, 3000)), (None, "no id"), (3, words(3, 121)), (3, words(3, 121))]
    out = pack(docs(rows), PATH, capacity=256).collect()
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in out:
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for x in by_seq.values():
        end = 0
        for o, n in sorted(x):
            assert o == end and n > 0
            end += n
        assert end <= 256
    want = defaultdict(list)
    for k, t in rows:
        ids = np.array([*whole(t or ""), 2], "<u4")
        cuts = [0, *range(len(ids) % 256 or 256, len(ids) + 1, 256)]
        want[k] += [(p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    total = sum(n for x in by_seq.values() for _, n in x)
    assert len(by_seq) <= -(-total // 256) + 2


def test_empty(docs):
    assert pack(docs([]), PATH).collect() == []
