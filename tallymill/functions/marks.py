"""Families of phrases that a text may hold, told in one column before any exact test runs.

A list of substring tests costs one search of the text for each phrase. Here all phrases of a family are one pattern of Arrow's
linear-time matcher, which reads a text once however many there are. A family only says what is possible: who tests exactly, asks
it first. Its patterns read lower-cased text and must hit wherever the exact test holds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.functions import arrow_udf

#: Families that are looked for one by one only in texts that hold some of them.
TOGETHER = 6
#: Bits of the column.
BITS = 62


def phrases(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in dict.fromkeys(words))


def spaced(words: list[str], between: str) -> str:
    """The words, with any of the signs of ``between`` among their letters."""
    gap = f"[{re.escape(between)}]*"
    return "|".join(gap.join(map(re.escape, w)) for w in words)


def linear(pattern: str) -> str | None:
    """A marked Java pattern over lower-cased text as the matcher writes it, or a wider one: it has no look-around, and its blanks
    lack one. None for what the two may read differently."""
    text = re.sub(r"\(\?!.*\)$", "", pattern)
    if "(?" in text.replace("(?:", "") or "&&" in text or re.search(r"\\[^\W_dsw<>]", text.replace("\\\\", "")) or re.search(r"[+*?}]\+", text):
        return None
    text = re.sub(r"\\<(?=[a-z0-9]|\\[dw])", r"\\b", re.sub(r"\\>$", "(?:[^A-Za-z0-9_]|$)", text))
    text = text.replace(r"\<", "").replace(r"\>", "")
    return re.sub(r"\[(?:\\.|[^\]\\])*\]|\\s", lambda m: m[0].replace(r"\s", r"\s\x0b") if m[0][0] == "[" else r"[\s\x0b]", text)


@dataclass(frozen=True)
class Marks:
    """A column of marks and the families of its bits."""

    column: str
    families: tuple[str, ...]


def marked(marks: Marks, name: str) -> str:
    return f"(({marks.column} & {1 << marks.families.index(name)}L) <> 0)"


def ask(marks: Marks | None, name: str, test: str) -> str:
    """The test behind the mark of its family; the test alone where there are no marks or no such family."""
    return test if marks is None or name not in marks.families else f"({marked(marks, name)} AND {test})"


def with_marks(texts: DataFrame, families: dict[str, str], column: str = "_marks") -> tuple[DataFrame, Marks]:
    """Add ``column``: a bit for each family, set where its pattern hits ``_low``; 0 for a null text. Families beyond the bits
    have no mark."""
    families = dict(list(families.items())[:BITS])
    patterns = list(families.values())
    blocks = [patterns[i : i + TOGETHER] for i in range(0, len(patterns), TOGETHER)]

    @arrow_udf("long")
    def marks(low: pa.Array) -> pa.Array:
        def hits(values: pa.Array, pattern: str) -> np.ndarray:
            return np.asarray(pc.fill_null(pc.match_substring_regex(values, pattern), False).to_numpy(zero_copy_only=False), dtype=bool)

        out, bit = np.zeros(len(low), dtype=np.int64), 0
        for block in blocks:
            rows = np.flatnonzero(hits(low, "|".join(f"(?:{p})" for p in block)))
            some = low.take(pa.array(rows)) if len(rows) else None
            for pattern in block:
                if some is not None:
                    out[rows] |= hits(some, pattern).astype(np.int64) << bit
                bit += 1
        return pa.array(out)

    return texts.withColumn(column, marks("_low")), Marks(column, tuple(families))
