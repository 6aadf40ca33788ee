"""Work of the repeat removal: shared runs are looked up in one sorted list, suffixes are sorted as words."""

import numpy as np
import odd
import pyarrow as pa
import pytest

from waveloom.llm import repeats


def test_shared_runs_are_not_deduplicated_for_every_few_texts(monkeypatch):
    texts = [odd.prose(k, 120).encode() for k in range(60)]
    docs = pa.table({"doc_id": pa.array(range(60), pa.int64()), "check": pa.array(range(60), pa.int64()), "text": pa.array(texts, pa.binary())})
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    runs = repeats.Runs(np.frombuffer(b"".join(texts), np.uint8), off, 50)
    wanted = np.arange(len(runs.row)) % 3 == 0
    rows = runs.row[wanted].astype(np.int64)
    ref = repeats.pack(rows, rows, runs.pos[wanted].astype(np.uint32))
    seen, plain = [], np.isin
    monkeypatch.setattr(np, "isin", lambda a, b, **more: (seen.append(len(a) + len(b)), plain(a, b, **more))[1])
    monkeypatch.setattr(repeats, "CHUNK", 2048)
    found = repeats._Group(docs, [ref, ref], 50)
    assert list(zip(found.row, found.start)) == list(zip(runs.row[wanted], runs.start[wanted]))
    assert sum(seen) <= 2 * len(runs.row)
    assert len(repeats._Group(docs, [], 50).row) == 0


@pytest.mark.parametrize("kinds", [1, 2, 40, 257])
@pytest.mark.parametrize("n", [1, 2, 300, 5000])
def test_suffixes_are_ordered_by_their_first_codes(n, kinds):
    codes = np.random.default_rng(n + kinds).integers(0, kinds, n).astype(np.uint16)
    codes[n // 2:] = codes[: n - n // 2]  # long common prefixes
    for length in (1, 5, 7, 50):
        order, short = repeats.suffix_order(codes, length)
        padded = np.concatenate([codes, np.zeros(length, np.uint16)])
        words = [tuple(padded[i:i + length]) for i in range(n)]
        assert sorted(order.tolist()) == list(range(n))
        assert [words[i] for i in order] == sorted(words)
        heads = [w[: repeats.KEY] for w in words]
        assert all((short[i] < short[j]) == (heads[i] < heads[j]) for i, j in zip(order[:-1], order[1:]))


@pytest.mark.parametrize("bits", [8, 40, 62, 64])
def test_both_ways_to_sort_keys(bits):
    key = np.random.default_rng(bits).integers(0, 1 << min(bits, 63), 3000).astype(np.uint64)
    order, ordered = repeats._sorted_keys(key, bits)
    assert sorted(order.tolist()) == list(range(3000))
    assert (key[order] == ordered).all() and (ordered == np.sort(key)).all()
