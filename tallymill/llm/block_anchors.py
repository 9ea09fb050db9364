"""Exact word repeats found through fixed blocks as anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallymill.llm.chunks import MESSAGE, Chunked, chunked, firsts, per_chunk, short, slabs, table
from tallymill.llm.common import mix64

KEYS = "bucket int, chunk int, keys binary, blocks binary, many binary"
WINDOWS = "bucket int, chunk int, keys binary, many binary"
RESULT = "doc_id long, n_words long, spans array<struct<start:long,stop:long>>, kept binary"

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Odd bases, so that each has an inverse modulo 2 ** 64.
_BASES = [int(x) * 2 + 1 for x in _rng.integers(1 << 40, 1 << 60, 3)]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of a base and of its inverse."""
    if which not in _powers or len(_powers[which][0]) <= n:
        base, size = _BASES[which], 1 << (n + 1).bit_length()
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[which] = (out[0], out[1])
    return _powers[which]


def _ranges(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, which: int) -> np.ndarray:
    """A hash of values[start:stop] for each range, equal for equal sequences wherever they lie."""
    up, down = _power(which, len(values))
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix64((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))


class Words:
    """Words of some texts: a hash of each, the text of each, and the number of words of each text."""

    def __init__(self, texts: list[bytes]) -> None:
        data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        edge = np.diff(np.concatenate([[True], _BLANK[data]]).astype(np.int8))
        self.starts, self.stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.hashes = _ranges(_BYTE[data], self.starts, self.stops, 0)
        ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
        bounds = np.searchsorted(self.starts, ends)
        self.counts = np.diff(bounds, prepend=0)
        self.first = bounds - self.counts  # number of each text's first word

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows within a text, and their places in it."""
        n = np.maximum(self.counts - length + 1, 0)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(self.first, n) + place, place

    def window_hash(self, starts: np.ndarray, length: int, which: int) -> np.ndarray:
        return _ranges(self.hashes, starts, starts + length, which)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and whether each occurs twice or more."""
    keys = np.sort(keys)
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(new)
    return keys[at], np.diff(np.append(at, len(keys))) > 1


def _block(length: int) -> int:
    """The longest block such that every window of ``length`` words holds a whole one."""
    return max(1, (length + 1) // 2)


def _anchors(c: Chunked, length: int) -> DataFrame:
    """For each chunk and bucket: the distinct rolling block-length sequences, which of them are reference blocks, and
    which occur twice or more in the chunk."""
    block, n_buckets = _block(length), c.n_buckets

    def work(docs: pa.Table, messages: pa.Table) -> pa.Table:
        out = {k.split()[0]: [] for k in KEYS.split(", ")}
        rows, _ = firsts(docs, messages)
        if len(rows):
            texts, chunk = docs["text"].take(rows).to_pylist(), docs["chunk"][0].as_py()
            probes, blocks = [], []
            for _, part in slabs(texts):
                w = Words(part)
                starts, place = w.windows(block)
                h = w.window_hash(starts, block, 1)
                probes.append(short(h, n_buckets))
                blocks.append(probes[-1][place % block == 0])
            keys, many = _distinct(np.concatenate(probes))
            of_block = np.isin(keys, np.concatenate(blocks), assume_unique=False)
            bucket = (keys >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for k, m, b, u in zip(*(np.split(x, cuts) for x in (keys, many, of_block, bucket))):
                if len(k):
                    out["bucket"].append(int(u[0]))
                    out["chunk"].append(chunk)
                    out["keys"].append(k.astype(np.uint32).tobytes())
                    out["blocks"].append(np.packbits(b).tobytes())
                    out["many"].append(np.packbits(m).tobytes())
        return table(KEYS, out)

    return per_chunk(c.docs, c.first, work, KEYS)


def _bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=n).astype(bool)


def _send(chunks: np.ndarray, keys: np.ndarray, kind: int) -> pa.Table:
    """Messages that give each chunk its keys."""
    out = {k.split()[0]: [] for k in MESSAGE.split(", ")}
    order = np.argsort(chunks, kind="stable")
    chunks, keys = chunks[order], keys[order]
    cuts = np.flatnonzero(np.diff(chunks)) + 1
    for c, k in zip(np.split(chunks, cuts), np.split(keys, cuts)):
        if len(c):
            out["chunk"].append(int(c[0]))
            out["kind"].append(kind)
            out["keys"].append(k.tobytes())
            out["more"].append(None)
    return table(MESSAGE, out)


def _repeated_blocks(rows: pa.Table) -> pa.Table:
    """Of one bucket, the sequences that occur twice and of which one occurrence is a reference block."""
    parts = [np.frombuffer(x, dtype=np.uint32) for x in rows["keys"].to_pylist()]
    n = [len(x) for x in parts]
    keys = np.concatenate(parts)
    chunks = np.repeat(np.array(rows["chunk"].to_pylist(), dtype=np.int32), n)
    block, many = (np.concatenate([_bits(x, k) for x, k in zip(rows[c].to_pylist(), n)]) for c in ("blocks", "many"))
    order = np.argsort(keys, kind="stable")
    keys, chunks, block, many = keys[order], chunks[order], block[order], many[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(at, len(keys)))
    good = ((size > 1) | np.logical_or.reduceat(many, at)) & np.logical_or.reduceat(block, at)
    good = np.repeat(good, size)
    bucket = np.uint64(rows["bucket"][0].as_py()) << np.uint64(32)
    return _send(chunks[good], keys[good].astype(np.uint64) | bucket, 1)


def _gathered(messages: pa.Table, kind: int, width: int = 1) -> np.ndarray:
    found = [k for t, k in zip(messages["kind"].to_pylist(), messages["keys"].to_pylist()) if t == kind]
    return np.frombuffer(b"".join(found), dtype=np.uint64).reshape(-1, width)


def _candidates(c: Chunked, messages: DataFrame, length: int) -> DataFrame:
    """Windows around hits: those of ``length`` words that hold a hit, by two hashes, distinct within the chunk."""
    block, n_buckets = _block(length), c.n_buckets

    def work(docs: pa.Table, messages: pa.Table) -> pa.Table:
        out = {k.split()[0]: [] for k in WINDOWS.split(", ")}
        hits = np.unique(_gathered(messages, 1))
        if len(hits):
            rows, _ = firsts(docs, messages)
            texts, chunk = docs["text"].take(rows).to_pylist(), docs["chunk"][0].as_py()
            found = []
            for _, part in slabs(texts):
                w = Words(part)
                starts, _ = w.windows(block)
                hit = np.zeros(len(w.hashes) + 1, dtype=np.int64)
                hit[starts[np.isin(short(w.window_hash(starts, block, 1), n_buckets), hits)] + 1] = 1
                before = np.cumsum(hit)
                starts, _ = w.windows(length)
                starts = starts[before[starts + length - block + 1] > before[starts]]
                found.append(np.stack([w.window_hash(starts, length, 1), w.window_hash(starts, length, 2)], axis=1))
            pairs = np.concatenate(found)
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
            if len(pairs):
                new = np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)])
                at = np.flatnonzero(new)
                many = np.diff(np.append(at, len(pairs))) > 1
                pairs = pairs[at]
                bucket = ((pairs[:, 0] >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                pairs, many, bucket = pairs[order], many[order], bucket[order]
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                for p, m, b in zip(np.split(pairs, cuts), np.split(many, cuts), np.split(bucket, cuts)):
                    out["bucket"].append(int(b[0]))
                    out["chunk"].append(chunk)
                    out["keys"].append(p.tobytes())
                    out["many"].append(np.packbits(m).tobytes())
        return table(WINDOWS, out)

    return per_chunk(c.docs, messages, work, WINDOWS)


def _repeated_windows(rows: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x, dtype=np.uint64).reshape(-1, 2) for x in rows["keys"].to_pylist()]
    n = [len(x) for x in parts]
    pairs = np.concatenate(parts)
    chunks = np.repeat(np.array(rows["chunk"].to_pylist(), dtype=np.int32), n)
    many = np.concatenate([_bits(x, k) for x, k in zip(rows["many"].to_pylist(), n)])
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs, chunks, many = pairs[order], chunks[order], many[order]
    at = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)]))
    size = np.diff(np.append(at, len(pairs)))
    good = np.repeat((size > 1) | np.logical_or.reduceat(many, at), size)
    return _send(chunks[good], pairs[good], 2)


def _spans(place: np.ndarray, length: int) -> list[dict[str, int]]:
    """Maximal runs covered by windows that start at the sorted places."""
    if not len(place):
        return []
    cut = np.flatnonzero(np.diff(place) > length) + 1
    return [{"start": int(p[0]), "stop": int(p[-1]) + length} for p in np.split(place, cut)]


def repeated_words(docs: DataFrame, length: int = 35, **sizes: int) -> DataFrame:
    """Maximal word repeats of each row: doc_id, n_words, spans (word numbers, stop excluded), kept (the other words,
    joined by one space).

    A window of ``length`` words repeats if its word sequence also starts anywhere else, in the same text or another;
    the window is judged on the input. Non-overlapping blocks of (length + 1) / 2 words are the index: every window
    holds a whole one, so a repeated window has, at each of its occurrences, a rolling sequence that equals a block.
    Those hits are extended to whole windows, compared by 128 bits, and windows that touch join to maximal repeats.
    Texts given twice or more are all repeats if they have ``length`` words; one of them stands for all in the
    search. A null or empty text has no words. A null doc_id is answered like any other; rows that repeat are texts
    given twice. An empty table gives an empty one; other columns are left out.
    """
    c = chunked(docs, **sizes)
    hits = _anchors(c, length).groupBy("bucket").applyInArrow(_repeated_blocks, MESSAGE)
    windows = _candidates(c, hits.unionByName(c.first), length)
    marks = windows.groupBy("bucket").applyInArrow(_repeated_windows, MESSAGE)

    def work(docs: pa.Table, messages: pa.Table) -> pa.Table:
        rows, times = firsts(docs, messages)
        first = set(rows.tolist())
        marks = _gathered(messages, 2, 2)
        marks = marks[np.lexsort((marks[:, 1], marks[:, 0]))]
        digests, texts = docs["digest"].to_pylist(), docs["text"].to_pylist()
        n_words, spans, kept = [], [], []
        for at, part in slabs(texts):
            w = Words(part)
            starts, place = w.windows(length)
            one = w.window_hash(starts, length, 1)
            near = np.searchsorted(marks[:, 0], one)
            known = np.zeros(len(one), dtype=bool)
            inside = near < len(marks)
            known[inside] = marks[near[inside], 0] == one[inside]
            if known.any():
                two = w.window_hash(starts[known], length, 2)
                pairs = set(map(tuple, marks[np.isin(marks[:, 0], one[known])].tolist()))
                known[known] = [p in pairs for p in zip(one[known].tolist(), two.tolist())]
            starts, place = starts[known], place[known]
            cuts = np.searchsorted(starts, w.first)
            for i, text in enumerate(part):
                n = int(w.counts[i])
                # a text that is first elsewhere, or has a twin, repeats as a whole
                if n >= length and (at + i not in first or times.get(digests[at + i], 1) > 1):
                    found = [{"start": 0, "stop": n}]
                else:
                    stop = cuts[i + 1] if i + 1 < len(part) else len(starts)
                    found = _spans(place[cuts[i] : stop], length)
                tokens = text.split()
                left, rest = 0, []
                for s in found:
                    rest += tokens[left : s["start"]]
                    left = s["stop"]
                n_words.append(n)
                spans.append(found)
                kept.append(b" ".join(rest + tokens[left:]))
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.table(
            {"doc_id": docs["doc_id"], "n_words": pa.array(n_words, pa.int64()), "spans": pa.array(spans, span), "kept": pa.array(kept, pa.binary())}
        )

    return per_chunk(c.docs, marks.unionByName(c.first), work, RESULT)
