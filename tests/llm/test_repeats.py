"""Suffix blocks and block anchors against brute force."""

from collections import Counter

import numpy as np
import pytest

from tallymill.llm import block_anchors, suffix_blocks
from tests.llm.conftest import rows_of


def brute_bytes(rows, length):
    """Kept bytes of (doc_id, text) rows, by their definition."""
    least = {}
    for i, t in rows:
        for j in range(len(t) - length + 1 if i is not None else 0):
            s = t[j : j + length]
            least[s] = min(i, least.get(s, i))
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for j in range(len(t) - length + 1 if i is not None else 0):
            if least[t[j : j + length]] < i:
                gone[j : j + length] = b"\1" * length
        out.append((i, len(t), bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=repr)


def brute_words(rows, length):
    split = [(i, t.split()) for i, t in rows]
    n = Counter(tuple(w[j : j + length]) for _, w in split for j in range(len(w) - length + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for j in range(len(w) - length + 1):
            if n[tuple(w[j : j + length])] > 1:
                gone[j : j + length] = [True] * length
        out.append((i, len(w), b" ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


def texts(frame):
    return [(r["doc_id"], (r["text"] or "").encode()) for r in rows_of(frame.select("doc_id", "text"))]


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 30_000, "bucket_bytes": 60_000}])
@pytest.mark.parametrize("which", ["odd", "given"])
def test_repeated_words(request, which, sizes):
    docs = request.getfixturevalue(which)
    got = rows_of(block_anchors.repeated_words(docs, 35, **sizes))
    assert sorted(((r["doc_id"], r["n_words"], bytes(r["kept"])) for r in got), key=repr) == brute_words(texts(docs), 35)


@pytest.mark.parametrize("salt", [64, 1])
@pytest.mark.parametrize("which", ["odd", "given"])
def test_repeated_bytes(request, monkeypatch, which, salt):
    monkeypatch.setattr(suffix_blocks, "SALT_CHUNKS", salt)  # 1: every shared key is sorted in two levels
    docs = request.getfixturevalue(which)
    got = rows_of(suffix_blocks.repeated_bytes(docs, 50, chunk_bytes=30_000, bucket_bytes=60_000))
    assert sorted(((r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in got), key=repr) == brute_bytes(texts(docs), 50)


def test_spans_are_maximal_and_may_keep_characters(odd):
    for r in rows_of(suffix_blocks.repeated_bytes(odd, 50, whole_characters=True)):
        bytes(r["kept"]).decode()
        ends = [(s["start"], s["stop"]) for s in r["spans"]]
        assert all(a < b for a, b in ends) and all(x[1] < y[0] for x, y in zip(ends, ends[1:]))
        assert r["n_bytes"] == len(r["kept"]) + sum(b - a for a, b in ends)


def test_no_documents(nothing):
    assert rows_of(block_anchors.repeated_words(nothing)) == []
    assert rows_of(suffix_blocks.repeated_bytes(nothing)) == []


def test_short_windows_are_refused(nothing):
    with pytest.raises(ValueError):
        suffix_blocks.repeated_bytes(nothing, 20)


def test_suffixes_are_sorted_to_their_depth():
    rng = np.random.default_rng(5)
    for letters in (1, 2, 4):
        data = rng.integers(97, 97 + letters, 3000).astype(np.uint8)
        data[1500:1800] = data[100:400]
        starts = np.arange(3000 - 50)
        order, group = suffix_blocks.sort_suffixes(data, starts, 50)
        found = [data[s : s + 50].tobytes() for s in order]
        assert found == sorted(found)
        assert [a == b for a, b in zip(found, found[1:])] == (group[1:] == group[:-1]).tolist()
