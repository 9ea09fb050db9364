"""Packing into training sequences by power-of-two decomposition."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import stored

LONGEST = 4096
#: Words, and as many parts of words, whose ids a Python worker keeps; beyond it, it starts over.
KEPT_WORDS = 300_000
#: Characters that are encoded at a time.
CHARS = 1_000_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"


_ODD = re.compile("[\x1c-\x1f]")
_BLANK = re.compile(r"[ \t\n\r]+")


def _split(text: str) -> list[str]:
    """Words between white space; four control characters are white space to Python only."""
    return [w for w in _BLANK.split(text) if w] if _ODD.search(text) else text.split()


#: A word of these characters alone is not changed by normalisation but for its case, and splits as _PART says.
_PLAIN = re.compile("[!-~\u00c0-\u00ff]+")
#: Ends of words are parts of their own.
_PART = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


class _Numbers(dict):
    """Numbers for words, in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _gather(ids: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the entries ``at``, one after the other, and where each ends; entries lie in ``ids`` in order, each of its length."""
    starts = np.cumsum(lengths) - lengths
    sizes = lengths[at]
    ends = np.cumsum(sizes)
    return ids[np.repeat(starts[at] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))], ends


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if it is printable, else one of the
    letters from 256 on, in turn."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Token ids of texts. The tokenizer drops white space before anything else, so a text's ids are those of its
    words one after the other, and a word is encoded once as long as it is kept. Plain words are taken apart here and
    their parts go to the tokenizer's model; all other words, and those that may hold a special token, go through the
    whole tokenizer."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.clear()
        self.clear_parts()

    def clear(self) -> None:
        self.number = _Numbers()
        self.lengths = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def clear_parts(self) -> None:
        self.part = _Numbers()
        self.part["\n"] = 0
        self.part_lengths = np.zeros(1, dtype=np.int64)
        self.part_ids = np.zeros(0, dtype=np.uint32)

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words one after the other, and the number of ids of each. All words are taken apart at once."""
        known = len(self.part)
        parts = _PART.findall("\n".join([*words, ""]).lower())
        at = np.fromiter(map(self.part.__getitem__, parts), np.int64, len(parts))
        if len(self.part) > known:
            spelled = (p.encode().decode("latin-1").translate(self.letters) for p in islice(self.part, known, None))
            got = [[t.id for t in self.model.tokenize(p)] for p in spelled]
            self.part_lengths = np.concatenate([self.part_lengths, np.fromiter(map(len, got), np.int64, len(got))])
            self.part_ids = np.concatenate([self.part_ids, np.fromiter(chain.from_iterable(got), np.uint32)])
        flat, ends = _gather(self.part_ids, self.part_lengths, at)
        return flat, np.diff(ends[at == 0], prepend=0)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and the number of ids of each."""
        plain = np.array(["<|" not in w and _PLAIN.fullmatch(w) is not None for w in words])
        if plain.all():
            return self._plain(words)
        whole = [self.tokenizer.encode(w, add_special_tokens=False).ids for w, p in zip(words, plain.tolist()) if not p]
        ids, sizes = self._plain([w for w, p in zip(words, plain.tolist()) if p])
        lengths = np.zeros(len(words), dtype=np.int64)
        lengths[plain], lengths[~plain] = sizes, [len(x) for x in whole]
        out = np.zeros(int(lengths.sum()), dtype=np.uint32)
        own = np.repeat(plain, lengths)
        out[own], out[~own] = ids, np.fromiter(chain.from_iterable(whole), np.uint32)
        return out, lengths

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by end_id, and the number of ids of each."""
        if len(self.number) > KEPT_WORDS:
            self.clear()
        if len(self.part) > KEPT_WORDS:
            self.clear_parts()
        split = [_split(x) for x in texts]
        number = self.number
        known = len(number)
        n_words = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        at = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(number.__getitem__, x), np.int64, len(x)) for x in split)])
        if len(number) > known:
            ids, lengths = self._words(list(islice(number, known, None)))
            self.lengths = np.concatenate([self.lengths, lengths])
            self.ids = np.concatenate([self.ids, ids])
        flat, ends = _gather(self.ids, self.lengths, at)
        bounds = np.concatenate([[0], ends])[np.cumsum(n_words)]  # ids up to the end of each text
        return np.insert(flat, bounds, np.uint32(end_id)), np.diff(bounds, prepend=0) + 1


def _cuts(n: int, longest: int) -> list[int]:
    """n as a sum: as many of ``longest`` as fit, then the powers of two of the rest, largest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts, some millions of characters at a time."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1)):  # one value at a time: a batch can be large
            ids.append(i.as_py())
            texts.append(t.as_py() or "")
            held += len(texts[-1])
            if held >= CHARS:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, longest: int = LONGEST, with_ids: bool = True) -> DataFrame:
    """Documents cut into pieces of power-of-two length: doc_id, start, length, ids_crc32, doc_tokens, ids.

    A null text is an empty one, which is the end id alone. Rows that repeat are cut each by itself. A document's pieces
    come largest first, whole ``longest`` ones before them. tokenizer_path is a file that every executor has. An empty
    table gives no piece; other columns are left out. ids is null if ``with_ids`` is false.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer_path)
        for ids, texts in _texts(batches):
            flat, sizes = words.encode(texts, end_id)
            flat = flat.astype("<u4")
            out, at = [], 0
            raw = memoryview(flat.tobytes())
            for doc, n in zip(ids, sizes.tolist()):
                start = 0
                for k in _cuts(n, longest):
                    a = at + start
                    out.append((doc, start, k, zlib.crc32(raw[4 * a : 4 * (a + k)]), n, flat[a : a + k] if with_ids else None))
                    start += k
                at += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, type=t) for x, t in zip(zip(*out), (pa.int64(),) * 5 + (pa.list_(pa.int32()),))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def pack(cut: DataFrame, exchange: bool = True) -> DataFrame:
    """Sequences out of pieces: pieces of equal length lie together, and each is a sequence of its own, so that none
    crosses documents and, all being powers of two, none is padded. sequence_id is unique and, with an exchange, rises with the
    length over the whole table. The pieces are stored first then: dealing by range reads them twice. Without one, pieces of
    equal length lie together in each part of the table and ids never move: right for pieces that carry theirs."""
    rows = stored(cut, "pieces").repartitionByRange("length", F.xxhash64("doc_id", "start")) if exchange else cut
    return (
        rows.sortWithinPartitions("length", "doc_id", "start")
        .withColumn("sequence_id", F.monotonically_increasing_id())
        .withColumn("offset", F.lit(0).cast("long"))
    )
