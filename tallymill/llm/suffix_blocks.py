"""Repeated byte strings by blockwise suffix sorting with a difference cover."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.chunks import MESSAGE, Chunked, bucket_of, chunked, firsts, per_chunk, short, table
from tallymill.llm.common import mix64, stored

#: Every residue modulo PERIOD is a difference of two members: for any two places there is a shift below PERIOD that
#: moves both into the cover.
PERIOD = 13
COVER = (0, 1, 3, 9)
#: Bytes hashed at a time, and segment bytes whose suffixes are sorted at a time.
SLAB_BYTES = 1 << 18
BLOCK_BYTES = 1 << 19
#: Chunks that one sorting group takes segments of one key from; a key of more is salted and sorted in two levels.
SALT_CHUNKS = 64
#: Bytes of the strings whose smallest hash in a window names the window's bucket.
SEED_BYTES = 16

KEYS = "bucket int, chunk int, keys binary, many binary"
SEGMENTS = (
    "bucket int, salt int, chunk int, kind int, docs binary, chunks binary, keys binary, starts binary, sizes binary, text binary"
)
#: Positions in a text are below it.
TAG = 1 << 40
RESULT = "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary, digest binary"

_rng = np.random.default_rng(7)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = [np.uint64(int(x) * 2 + 1) for x in _rng.integers(1 << 40, 1 << 60, 4)]


def _shift_table() -> np.ndarray:
    out = np.zeros((PERIOD, PERIOD), dtype=np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            out[a, b] = next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER)
    return out


_SHIFT = _shift_table()
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _least_hash(data: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``length`` bytes, the smallest hash of its SEED_BYTES-byte strings."""
    h, n = _BYTE[data], 1
    for step in _STEP:  # hashes of 2, 4, 8 and 16 bytes
        h = h[:-n] * step + h[n:]
        n *= 2
    h = mix64(h)
    width, n = length - SEED_BYTES + 1, 1
    while 2 * n <= width:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    if n < width:
        h = np.minimum(h[: len(h) - (width - n)], h[width - n :])
    return h


def _runs(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of consecutive windows with the same least hash: (number of the text, first window, windows, key). Long
    texts come in parts that overlap by length - 1 bytes."""
    parts, held = [], 0

    def flush() -> tuple[np.ndarray, ...]:
        data = np.frombuffer(b"".join(p[2] for p in parts) + bytes(length), dtype=np.uint8)
        sizes = np.array([len(p[2]) for p in parts])
        offsets = np.cumsum(sizes) - sizes
        n = sizes - length + 1
        starts = np.repeat(offsets - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        value = _least_hash(data, length)[starts]
        first = np.concatenate([[True], (value[1:] != value[:-1]) | (np.diff(starts) != 1)])
        at = np.flatnonzero(first)
        part = np.searchsorted(offsets, starts[at], side="right") - 1
        doc = np.array([p[0] for p in parts])[part]
        place = starts[at] - offsets[part] + np.array([p[1] for p in parts])[part]
        return doc, place, np.diff(np.append(at, len(starts))), mix64(value[at])

    for i, t in enumerate(texts):
        for o in range(0, len(t) - length + 1, SLAB_BYTES):
            parts.append((i, o, t[o : o + SLAB_BYTES + length - 1]))
            held += len(parts[-1][2])
            if held >= SLAB_BYTES:
                yield flush()
                parts, held = [], 0
    if parts:
        yield flush()


def sort_suffixes(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts in the order of the ``length`` bytes that follow them, and a class for each: equal for equal bytes.

    Starts are sorted by their first 16 bytes. Places in the difference cover get ranks by the bytes that follow
    them, as many as stay within every window. Ties meet a pivot of their own: both are shifted into the cover, where
    ranks compare at once all but the end of the windows, and the last 16 bytes settle the rest. What is below or above
    its pivot goes on to the next round.
    """
    depth = length - PERIOD + 1
    padded = np.concatenate([data, np.zeros(length + 16, dtype=np.uint8)])
    word = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(">u8").ravel().astype(np.uint64)
    need = np.zeros(len(data) + length, dtype=bool)
    for d in range(PERIOD):
        need[starts + d] = True
    cover = np.flatnonzero(need)
    cover = cover[_IN_COVER[cover % PERIOD]]
    columns = [word[cover + min(8 * k, depth - 8)] for k in range(-(-depth // 8))]
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(cover), dtype=bool)
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    rank = np.zeros(len(need), dtype=np.int64)
    rank[cover[order]] = np.cumsum(new)

    a, b = word[starts], word[starts + 8]
    order = np.lexsort((b, a))
    s, a, b = starts[order], a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(s) else np.zeros(0, dtype=bool)
    group = np.cumsum(new)
    size = np.bincount(group, minlength=1)
    open_ = np.flatnonzero(size[group] > 1)
    while len(open_):
        g, p = group[open_], s[open_]
        at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        n = np.diff(np.append(at, len(g)))
        pivot = np.repeat(p[at + n // 2], n)
        shift = _SHIFT[p % PERIOD, pivot % PERIOD]
        sign = np.sign(rank[p + shift] - rank[pivot + shift])
        for k in (length - 16, length - 8):
            x, y = word[p + k], word[pivot + k]
            sign = np.where(sign == 0, (x > y).astype(np.int64) - (x < y), sign)
        order = np.lexsort((sign, g))
        sign = sign[order]
        s[open_] = p[order]
        at = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (sign[1:] != sign[:-1])]))
        n = np.diff(np.append(at, len(g)))
        group[open_] = group.max() + 1 + np.repeat(np.arange(len(at)), n)
        open_ = open_[(np.repeat(n, n) > 1) & (sign != 0)]
    return s, group


def _keys(c: Chunked, length: int) -> DataFrame:
    """For each chunk and bucket the distinct keys of windows, and which of them two documents of the chunk have."""
    n_buckets = c.n_buckets

    def work(docs: pa.Table, messages: pa.Table) -> pa.Table:
        out = {k.split()[0]: [] for k in KEYS.split(", ")}
        rows, _ = firsts(docs, messages)
        found = [(short(k, n_buckets), d) for d, _, _, k in _runs(docs["text"].take(rows).to_pylist(), length)] if len(rows) else []
        if found:
            keys, doc = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
            order = np.lexsort((doc, keys))
            keys, doc = keys[order], doc[order]
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            last = np.append(at[1:], len(keys)) - 1
            many, keys = doc[at] != doc[last], keys[at]
            bucket = (keys >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for k, m, u in zip(np.split(keys, cuts), np.split(many, cuts), np.split(bucket, cuts)):
                out["bucket"].append(int(u[0]))
                out["chunk"].append(docs["chunk"][0].as_py())
                out["keys"].append(k.astype(np.uint32).tobytes())
                out["many"].append(np.packbits(m).tobytes())
        return table(KEYS, out)

    return per_chunk(c.docs, c.first, work, KEYS)


def _shared_keys(rows: pa.Table) -> pa.Table:
    """Messages of kind 1 to each chunk: its keys that another document has, and the salts of each."""
    parts = [np.frombuffer(x, dtype=np.uint32) for x in rows["keys"].to_pylist()]
    n = [len(x) for x in parts]
    keys = np.concatenate(parts)
    chunks = np.repeat(np.array(rows["chunk"].to_pylist(), dtype=np.int32), n)
    many = np.concatenate([np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=k) for x, k in zip(rows["many"].to_pylist(), n)])
    order = np.argsort(keys, kind="stable")
    keys, chunks, many = keys[order], chunks[order], many[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(at, len(keys)))
    good = np.repeat((size > 1) | (np.maximum.reduceat(many, at) > 0), size)
    salts = np.repeat(-(-size // SALT_CHUNKS), size)[good].astype(np.uint32)
    keys, chunks = keys[good], chunks[good]
    order = np.argsort(chunks, kind="stable")
    keys, chunks, salts = keys[order], chunks[order], salts[order]
    bucket = np.uint64(rows["bucket"][0].as_py()) << np.uint64(32)
    cuts = np.flatnonzero(np.diff(chunks)) + 1
    out = {k.split()[0]: [] for k in MESSAGE.split(", ")}
    for c, k, s in zip(np.split(chunks, cuts), np.split(keys, cuts), np.split(salts, cuts)):
        if len(c):
            out["chunk"].append(int(c[0]))
            out["kind"].append(1)
            out["keys"].append((k.astype(np.uint64) | bucket).tobytes())
            out["more"].append(s.tobytes())
    return table(MESSAGE, out)


def _segment_rows(bucket: np.ndarray, salt: np.ndarray, kind: int, columns: dict[str, np.ndarray], pieces: list[bytes]) -> dict[str, list]:
    """One row for each bucket and salt."""
    out = {k.split()[0]: [] for k in SEGMENTS.split(", ")}
    order = np.lexsort((salt, bucket))
    b, s = bucket[order], salt[order]
    cuts = np.flatnonzero((np.diff(b) != 0) | (np.diff(s) != 0)) + 1
    for part in np.split(order, cuts):
        if len(part):
            out["bucket"].append(int(bucket[part[0]]))
            out["salt"].append(int(salt[part[0]]))
            out["chunk"].append(None)
            out["kind"].append(kind)
            for name, values in columns.items():
                out[name].append(values[part].tobytes())
            out["text"].append(b"".join([pieces[i] for i in part]))
    return out


def _tag(digest: bytes) -> int:
    """What is added to the positions of a text, to tell texts of one doc_id apart: 23 bits of its digest."""
    return (int.from_bytes(digest[:3], "big") >> 1) * TAG


def _segments(c: Chunked, messages: DataFrame, length: int) -> DataFrame:
    """The bytes of all windows that share a key with another document, a run of windows at a time, sent to the key's
    bucket. A salted key is dealt by the chunk."""
    n_buckets = c.n_buckets

    def work(docs: pa.Table, messages: pa.Table) -> pa.Table:
        sent = [m for m in messages.to_pylist() if m["kind"] == 1]
        rows, _ = firsts(docs, messages)
        ids = docs["doc_id"].take(rows).to_pylist() if len(rows) else []
        rows = np.array([r for r, i in zip(rows, ids) if i is not None], dtype=np.int64)  # no id: neither smaller nor larger
        if not sent or not len(rows):
            return table(SEGMENTS, {k.split()[0]: [] for k in SEGMENTS.split(", ")})
        shared = np.frombuffer(b"".join(m["keys"] for m in sent), dtype=np.uint64)
        salts = np.frombuffer(b"".join(m["more"] for m in sent), dtype=np.uint32)
        order = np.argsort(shared)
        shared, salts = shared[order], salts[order]
        texts, chunk = docs["text"].take(rows).to_pylist(), docs["chunk"][0].as_py()
        ids = np.array(docs["doc_id"].take(rows).to_pylist(), dtype=np.int64)
        tags = np.array([_tag(d) for d in docs["digest"].take(rows).to_pylist()], dtype=np.int64)
        found, pieces = [], []
        for doc, start, n, key in _runs(texts, length):
            brief = short(key, n_buckets)
            at = np.minimum(np.searchsorted(shared, brief), len(shared) - 1)
            hit = shared[at] == brief
            doc, start, n, key, at = doc[hit], start[hit], n[hit], key[hit], at[hit]
            found.append((ids[doc], start + tags[doc], n + length - 1, key, salts[at]))
            pieces += [texts[d][s : s + k] for d, s, k in zip(doc.tolist(), start.tolist(), (n + length - 1).tolist())]
        if not pieces:
            return table(SEGMENTS, {k.split()[0]: [] for k in SEGMENTS.split(", ")})
        ids, start, size, key, salts = (np.concatenate(x) for x in zip(*found))
        columns = {
            "docs": ids, "chunks": np.full(len(ids), chunk, dtype=np.int32), "keys": key, "starts": start, "sizes": size,
        }
        salt = np.where(salts > 1, 1 + chunk % np.maximum(salts, 1).astype(np.int64), 0)
        return table(SEGMENTS, _segment_rows(bucket_of(key, n_buckets), salt, 0, columns, pieces))

    return per_chunk(c.docs, messages, work, SEGMENTS)


def _sort_buckets(length: int, final: bool):
    """Sorts the suffixes of one bucket, a block of whole keys at a time, and marks windows that start in a document
    with a smaller id. Rows out: kind 2, for a chunk, the marked windows as (doc, start, windows); kind 0, from salted
    groups, the segments with a window that is smallest in its group, which meet again without salt."""

    def work(rows: pa.Table) -> pa.Table:
        joined = {
            k: np.frombuffer(b"".join(rows[k].to_pylist()), dtype=t)
            for k, t in (("docs", np.int64), ("chunks", np.int32), ("keys", np.uint64), ("starts", np.int64), ("sizes", np.int64))
        }
        text = b"".join(rows["text"].to_pylist())
        sizes = joined["sizes"]
        offset = np.cumsum(sizes) - sizes
        order = np.lexsort((joined["docs"], joined["keys"]))
        key = joined["keys"][order]
        held = np.cumsum(sizes[order])
        ends = np.flatnonzero(np.append(key[1:] != key[:-1], True)) + 1  # where a key ends
        marks, again, at = [], [], 0
        while at < len(order):
            base = held[at - 1] if at else 0
            k = max(np.searchsorted(held[ends - 1], base + BLOCK_BYTES, side="right"), np.searchsorted(ends, at, side="right") + 1)
            stop = int(ends[min(k, len(ends)) - 1])
            part = order[at:stop]
            at = stop
            data = np.frombuffer(b"".join([text[o : o + z] for o, z in zip(offset[part].tolist(), sizes[part].tolist())]), dtype=np.uint8)
            z = sizes[part]
            o = np.cumsum(z) - z
            n = z - length + 1
            segment = np.repeat(np.arange(len(part)), n)
            starts = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + o[segment]
            ordered, group = sort_suffixes(data, starts, length)
            of = np.zeros(len(data), dtype=np.int64)
            of[starts] = segment
            of = of[ordered]
            doc = joined["docs"][part][of]
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            least = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(doc))))
            marked = np.zeros(len(data), dtype=bool)
            marked[ordered[doc > least]] = True
            hit = marked[starts]
            if not final and rows["salt"][0].as_py():
                again += part[np.bincount(segment, weights=~hit, minlength=len(part)) > 0].tolist()
            place, segment = starts[hit], segment[hit]
            if len(place):
                new = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 1) | (np.diff(segment) != 0)]))
                seg = segment[new]
                absolute = joined["starts"][part][seg] + place[new] - o[seg]
                runs = np.diff(np.append(new, len(place)))
                marks.append((joined["chunks"][part][seg], np.stack([joined["docs"][part][seg], absolute, runs], axis=1)))
        out = {k.split()[0]: [] for k in SEGMENTS.split(", ")}
        if again:
            pick = np.array(again)
            columns = {k: v[pick] for k, v in joined.items()}
            pieces = [text[a : a + b] for a, b in zip(offset[pick].tolist(), sizes[pick].tolist())]
            bucket = np.full(len(pick), rows["bucket"][0].as_py(), dtype=np.int64)
            out = _segment_rows(bucket, np.zeros(len(pick), dtype=np.int64), 0, columns, pieces)
        if marks:
            chunks, triples = np.concatenate([m[0] for m in marks]), np.concatenate([m[1] for m in marks])
            order = np.argsort(chunks, kind="stable")
            cuts = np.flatnonzero(np.diff(chunks[order])) + 1
            for p in np.split(order, cuts):
                for k in out:
                    out[k].append(None)
                out["chunk"][-1], out["kind"][-1], out["docs"][-1] = int(chunks[p[0]]), 2, triples[p].astype(np.int64).tobytes()
        return table(SEGMENTS, out)

    return work


def _to_chunks(found: DataFrame) -> DataFrame:
    return found.filter("kind = 2").select("chunk", "kind", F.col("docs").alias("keys"), F.col("text").alias("more"))


def _cover(places: np.ndarray, runs: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal byte spans under runs of windows, sorted by place."""
    if not len(places):
        return []
    stops = np.maximum.accumulate(places + runs + length - 1)
    new = np.flatnonzero(np.concatenate([[True], places[1:] > stops[:-1]]))
    return list(zip(places[new].tolist(), stops[np.append(new[1:], len(places)) - 1].tolist()))


def _whole(spans: list[tuple[int, int]], text: bytes) -> list[tuple[int, int]]:
    """Spans without the parts of characters at their ends, in UTF-8."""
    out = []
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def repeated_bytes(docs: DataFrame, length: int = 50, whole_characters: bool = False, **sizes: int) -> DataFrame:
    """Byte spans of each row that repeat a document with a smaller doc_id: doc_id, n_bytes, spans (stop excluded),
    kept (the other bytes), digest (MD5 of the row's text, which tells rows of one doc_id apart).

    A byte is in a span if a string of ``length`` bytes (29 at least) that covers it also starts in a document with a
    smaller doc_id; strings are judged on the input and never cross documents. Suffixes are needed to that depth only.
    Each window of ``length`` bytes belongs to the bucket of the least hash of its 16-byte strings, so equal windows
    share one, and consecutive windows mostly do. Keys that one document alone has are dropped; the others' windows
    travel to their bucket, whose suffixes are sorted one block of keys at a time. Keys of very many chunks are salted.
    Equal texts are told by their digest: all but the one with the smallest doc_id are spans as a whole if they have
    ``length`` bytes. Rows that repeat id and text are one document, rows of one
    id with different texts keep what is theirs. With whole_characters spans end between characters.
    A null or empty text has no bytes. A null doc_id is neither smaller nor larger than another: nothing is removed from
    it or because of it. An empty table gives an empty one; other columns are left out.
    """
    if length < PERIOD + 16:
        raise ValueError("windows must be longer")
    c = chunked(docs, **sizes)
    shared = _keys(c, length).groupBy("bucket").applyInArrow(_shared_keys, MESSAGE)
    segments = _segments(c, shared.unionByName(c.first), length)
    once = stored(segments.groupBy("bucket", "salt").applyInArrow(_sort_buckets(length, False), SEGMENTS), "suffix_marks")
    again = once.filter("kind = 0").groupBy("bucket").applyInArrow(_sort_buckets(length, True), SEGMENTS)
    marks = _to_chunks(once).unionByName(_to_chunks(again))

    def work(docs: pa.Table, messages: pa.Table) -> pa.Table:
        rows, _ = firsts(docs, messages)
        ids, digests, texts = (docs[k].to_pylist() for k in ("doc_id", "digest", "text"))
        own = {digests[r]: ids[r] for r in rows}
        parts = [np.frombuffer(m["keys"], dtype=np.int64) for m in messages.to_pylist() if m["kind"] == 2]
        marks = np.concatenate([np.zeros(0, dtype=np.int64), *parts]).reshape(-1, 3)
        marks = marks[np.lexsort((marks[:, 1], marks[:, 0]))]
        spans, kept = [], []
        for i, d, text in zip(ids, digests, texts):
            found = []
            if i is not None and len(text) >= length:
                if own.get(d, i - 1) != i:  # the text is first elsewhere, under a smaller id
                    found = [(0, len(text))]
                else:
                    tag = _tag(d)
                    a, b = np.searchsorted(marks[:, 0], [i, i + 1])
                    a, b = a + np.searchsorted(marks[a:b, 1], [tag, tag + TAG])
                    found = _cover(marks[a:b, 1] - tag, marks[a:b, 2], length)
            if whole_characters:
                found = _whole(found, text)
            left, rest = 0, []
            for a, b in found:
                rest.append(text[left:a])
                left = b
            spans.append([{"start": a, "stop": b} for a, b in found])
            kept.append(b"".join(rest) + text[left:])
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        sizes = pa.array([len(t) for t in texts], pa.int64())
        return pa.table({"doc_id": docs["doc_id"], "n_bytes": sizes, "spans": pa.array(spans, span), "kept": pa.array(kept, pa.binary()), "digest": docs["digest"]})

    return per_chunk(c.docs, marks.unionByName(c.first), work, RESULT)
