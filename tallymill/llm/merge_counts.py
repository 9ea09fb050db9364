"""Token counts by byte-pair merging with a heap and a linked list; no identifier is ever made."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Parts of texts whose counts a Python worker keeps; beyond it, it starts over.
KEPT_PARTS = 400_000
#: Characters that are split at a time.
CHARS = 1_000_000

#: How the vocabulary's library splits texts before merging, written for the characters of _PLAIN.
_PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters that Python's classes and the library's sort alike: ASCII without four control characters, and letters of
#: common scripts. Texts with others are split by the library.
_PLAIN = re.compile(
    "[\\x00-\\x1b\\x20-\\x7f\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u02af\\u0400-\\u0481\\u048a-\\u052f\\u2010-\\u2027"
    "\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fa5\\uac00-\\ud7a3]*"
)
#: A text can be cut here without changing its parts: no part crosses a space but one that starts with it.
_EDGE = re.compile("[A-Za-z0-9](?= )")


def _shown_bytes() -> dict[str, str]:
    """Letters by which a byte-level vocabulary writes bytes, back to the characters of these numbers: a printable byte
    is itself, the others are the letters from 256 on, in turn."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in shown]
    return {chr(256 + i): chr(b) for i, b in enumerate(rest)}


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after all merges: the pair of lowest rank goes first, of equal ranks the leftmost.

    The heap holds (rank, place of the left symbol) of pairs that may be merged, the list links each symbol to its
    neighbours. An entry whose pair has changed meanwhile is passed over when it comes up.
    """
    n = len(symbols)
    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapify(heap)
    merges = 0
    while heap:
        rank, i = heappop(heap)
        j = after[i]
        if symbols[i] is None or j == n or ranks.get((symbols[i], symbols[j])) != rank:
            continue
        symbols[i] += symbols[j]
        symbols[j] = None
        merges += 1
        after[i] = j = after[j]
        if j < n:
            before[j] = i
            r = ranks.get((symbols[i], symbols[j]))
            if r is not None:
                heappush(heap, (r, i))
        h = before[i]
        if h >= 0:
            r = ranks.get((symbols[h], symbols[i]))
            if r is not None:
                heappush(heap, (r, h))
    return n - merges


class _Counts(dict):
    """Tokens of a part of a text, worked out when it is first asked for."""

    def __init__(self, ranks: dict[tuple[str, str], int]) -> None:
        self.ranks = ranks

    def __missing__(self, part: str) -> int:
        raw = part.encode().decode("latin-1")
        self[part] = n = merged_length(list(raw), self.ranks) if len(raw) > 1 else 1
        return n


class MergeCounter:
    """Counts the tokens of texts under the merges of a byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        back = str.maketrans(_shown_bytes())
        pairs = (m if isinstance(m, list) else m.split(" ") for m in found["model"]["merges"])
        self.ranks = {(a.translate(back), b.translate(back)): r for r, (a, b) in enumerate(pairs)}
        self.special = [t["content"] for t in found["added_tokens"]]
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        # of special strings that start at one place the longest is taken
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.counts = _Counts(self.ranks)

    def _parts(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _PART.findall(text)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def _blocks(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > CHARS and (edge := _EDGE.search(text, at + CHARS)):
            yield text[at : edge.end()]
            at = edge.end()
        yield text[at:] if at else text

    def count(self, text: str) -> int:
        """Tokens of a text; each special string in it is one."""
        total, texts = 0, [text]
        if self.cut:
            texts = self.cut.split(text)
            total = len(texts) - 1
        for piece in texts:
            for block in self._blocks(piece):
                total += sum(map(self.counts.__getitem__, self._parts(block)))
                if len(self.counts) > KEPT_PARTS:
                    self.counts.clear()
        return total


_counters: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """The counter of a file, read once by each Python worker."""
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 1024) -> DataFrame:
    """Per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text is an empty one and has no token. Rows that repeat are counted each by itself, an empty table gives no
    row, other columns are left out. vocabulary_path is a byte-level file that every executor has; its special
    strings count as one token where a text holds them. Texts are taken whole, some million characters at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = counter(vocabulary_path)
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            n = [found.count(t.as_py()) for t in text]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(text).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, COUNTS)
