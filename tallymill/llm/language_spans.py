"""Language of texts: script ranges narrow the candidates, Viterbi labels the spans of mixed-language text."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letter triples are told apart by a hash of so many bits: with the number of languages, the bound of the model.
GRAM_BITS = 16
#: Characters scored at a time, over the number of languages.
SCORED = 2_000_000
PIECE = 1 << 20
#: Texts that are labelled together hold about so many characters.
GROUP = 2_000_000
UNKNOWN = "und"

#: First code point of ranges, in order, and the script of each. Latin with marks is apart from plain Latin.
SCRIPTS = (
    (0x0000, "plain"), (0x0080, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "burmese"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"),
    (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "other"), (0xFB50, "arabic"), (0xFE00, "other"), (0x20000, "han"), (0x32000, "other"),
)
NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))


@dataclass(frozen=True)
class Rule:
    """switch: what a change of language between two words costs, in natural log units. smoothing: added to the count
    of each letter triple. script_share: a language is a candidate for letters of a script that make up this
    part of its training letters or more."""

    switch: float = 12.0
    smoothing: float = 0.5
    script_share: float = 0.001


@dataclass
class Model:
    langs: list[str]
    grams: np.ndarray  # log probability of each triple in each language
    scripts: np.ndarray  # 0, or a large cost where the script is not of the language


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=1)
def _scripts() -> np.ndarray:
    out = np.zeros(0x110000, dtype=np.uint8)
    for start, name in SCRIPTS:
        out[start:] = NAMES.index(name)
    return out


_SPACE = re.compile(r"\s\S*\Z")


def _pieces(text: str) -> Iterator[str]:
    """A long text in parts, cut at white space if there is any near the end of a part."""
    at = 0
    while len(text) - at > PIECE:
        tail = _SPACE.search(text, at + PIECE - 4096, at + PIECE)
        stop = tail.start() if tail else at + PIECE
        yield text[at:stop]
        at = stop
    yield text[at:]


def _letter_runs(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of joined texts: code points with all but letters blanked, first and last+1 places of the letter runs, and the
    hash of the triple around each place."""
    points = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[points]
    points = np.where(letter, points, 32).astype(np.uint32)
    edge = np.diff(letter.astype(np.int8))
    starts, stops = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    mixed = np.zeros(len(points), dtype=np.uint32)
    mixed[1:-1] = points[:-2] * np.uint32(0x9E3779B1) + points[1:-1] * np.uint32(0x85EBCA77) + points[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return points, starts, stops, (mixed >> np.uint32(32 - GRAM_BITS)).astype(np.int64)


def train(docs: DataFrame, rule: Rule = Rule()) -> Model:
    """Counts of letter triples and of scripts in each language, over all rows with a text and a lang. Tasks send one
    count for each language and triple. The model that comes back has 2 ** GRAM_BITS numbers a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = defaultdict(lambda: np.zeros((1 << GRAM_BITS) + len(NAMES), dtype=np.int64))
        for batch in batches:
            held: dict[str, list[str]] = defaultdict(list)
            size: dict[str, int] = defaultdict(int)

            def add(lang: str) -> None:
                points, starts, stops, mixed = _letter_runs(held.pop(lang))
                inside = points != 32
                grams[lang][: 1 << GRAM_BITS] += np.bincount(mixed[inside], minlength=1 << GRAM_BITS)
                grams[lang][1 << GRAM_BITS :] += np.bincount(_scripts()[points[inside]], minlength=len(NAMES))
                size[lang] = 0

            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                for part in _pieces(text.as_py()):
                    held[lang].append(part.lower())
                    size[lang] += len(part)
                    if size[lang] > PIECE:
                        add(lang)
            for lang in list(held):
                add(lang)
        for lang, n in grams.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "gram", "n"]
            )

    counts = (
        docs.filter("text is not null and lang is not null")
        .select(F.col("text").cast("string"), F.col("lang").cast("string"))
        .mapInArrow(count, "lang string, gram int, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    found = counts.toArrow()
    langs = sorted(set(found["lang"].to_pylist()))
    place = {x: i for i, x in enumerate(langs)}
    n = np.zeros(((1 << GRAM_BITS) + len(NAMES), len(langs)))
    if langs:
        n[found["gram"].to_numpy(), [place[x] for x in found["lang"].to_pylist()]] = found["n"].to_numpy()
    grams, scripts = n[: 1 << GRAM_BITS] + rule.smoothing, n[1 << GRAM_BITS :]
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    ours = share >= rule.script_share
    cost = np.where(ours | ~ours.any(axis=1, keepdims=True), 0.0, -50.0)
    return Model(langs, np.log(grams / grams.sum(axis=0)).astype(np.float32), cost.astype(np.float32))


def _word_scores(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score of each letter run in each language, its letters, and the number of runs of each text."""
    scores, letters, owner = [], [], []
    held, size = [], 0

    def add() -> None:
        points, starts, stops, mixed = _letter_runs([p for _, p in held])
        sizes = np.array([len(p) + 1 for _, p in held])
        part = np.searchsorted(np.cumsum(sizes), starts - 1, side="right")
        owner.append(np.array([d for d, _ in held])[part])
        letters.append(stops - starts)
        step = max(1, SCORED // max(1, len(model.langs)) // 8)
        script = _scripts()
        for i in range(0, len(starts), step):
            a, b = starts[i : i + step], stops[i : i + step]
            n = b - a
            first = np.cumsum(n) - n
            at = np.repeat(a - first, n) + np.arange(int(n.sum()))
            scores.append(np.add.reduceat(model.grams[mixed[at]] + model.scripts[script[points[at]]], first, axis=0))

    for i, text in enumerate(texts):
        for part in _pieces(text):
            held.append((i, part.lower()))
            size += len(part)
            if size >= PIECE:
                add()
                held, size = [], 0
    if held:
        add()
    none = np.zeros((0, len(model.langs)), dtype=np.float32)
    owners = np.concatenate([np.zeros(0, np.int64), *owner]).astype(np.int64)
    return np.concatenate([none, *scores]), np.concatenate([np.zeros(0, np.int64), *letters]), np.bincount(owners, minlength=len(texts))


def viterbi(scores: np.ndarray, counts: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word, all sequences at once: sequences lie one after the other in scores."""
    order = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[order]
    n = counts[order]
    alive = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left")  # sequences of more than t words
    best = np.zeros(len(scores), dtype=np.int16)
    stay = np.ones(scores.shape, dtype=bool)
    value = scores[first[: alive[0]]].copy() if len(alive) and alive[0] else scores[:0]
    last = np.zeros(len(n), dtype=np.int64)
    for t in range(1, len(alive)):
        k = alive[t]
        if k < len(value):
            last[k : len(value)] = value[k:].argmax(axis=1)
            value = value[:k]
        at = first[:k] + t
        top = value.argmax(axis=1)
        limit = value[np.arange(k), top] - switch
        keep = value >= limit[:, None]
        best[at], stay[at] = top, keep
        value = np.where(keep, value, limit[:, None]) + scores[at]
    last[: len(value)] = value.argmax(axis=1) if len(value) else 0
    label = np.zeros(len(scores), dtype=np.int16)
    for t in range(len(alive) - 1, -1, -1):
        k = alive[t]
        at = first[:k] + t
        label[at] = last[:k]
        last[:k] = np.where(stay[at, last[:k]], last[:k], best[at])
    return label


def _label(model: Model, texts: list[str], switch: float) -> Iterator[tuple[str, float, list[dict], float]]:
    """Main language, its part of the letters, spans, and the mean score of a letter in the language of its span."""
    if not model.langs:
        yield from ((UNKNOWN, 0.0, [], -np.inf) for _ in texts)
        return
    scores, letters, counts = _word_scores(model, texts)
    label = viterbi(scores, counts, switch)
    n = len(model.langs)
    text = np.repeat(np.arange(len(texts)), counts)
    share = np.bincount(text * n + label, weights=letters, minlength=len(texts) * n).reshape(-1, n)
    total = share.sum(axis=1)
    fit = np.bincount(text, weights=scores[np.arange(len(label)), label], minlength=len(texts)) / np.maximum(total, 1)
    top = share.argmax(axis=1)
    ends = np.cumsum(counts)
    for i, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist())):
        if a == b:
            yield UNKNOWN, 0.0, [], -np.inf
            continue
        cut = np.flatnonzero(np.diff(label[a:b])) + 1
        bounds = [0, *cut.tolist(), b - a]
        spans = [{"start": x, "stop": y, "lang": model.langs[label[a + x]]} for x, y in zip(bounds, bounds[1:])]
        yield model.langs[top[i]], float(share[i, top[i]] / total[i]), spans, float(fit[i])


def identify(docs: DataFrame, model: Model, rule: Rule = Rule()) -> DataFrame:
    """doc_id, lang_pred, score (the part of a text's letters in spans of lang_pred) and spans (numbers of the letter
    runs, stop excluded, and the language) of every row.

    A run of letters is scored in each language by its letter triples; languages that do not use the script of a letter
    are out unless none does. Viterbi takes the labels that maximise the sum of scores less ``switch`` for each change.
    A null text, one without letters, and every text if nothing was learned, is ``und`` with score 0 and no spans. Ties
    go to the language that sorts first. Rows that repeat are answered each by itself; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages * 2 ** GRAM_BITS numbers

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))

        def out(ids: list, texts: list[str]) -> pa.RecordBatch:
            lang, score, spans, _ = zip(*_label(shared.value, texts, rule.switch))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, span)],
                names=["doc_id", "lang_pred", "score", "spans"],
            )

        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1)):  # one value at a time: a batch can be large
                ids.append(i.as_py())
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size >= GROUP:
                    yield out(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield out(ids, texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        each, "doc_id long, lang_pred string, score double, spans array<struct<start:int,stop:int,lang:string>>"
    )


def remainder(n: int):
    """The remainder that deals documents to folds; a null doc_id has 0."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n)), F.lit(0))


def keep_known(docs: DataFrame, model: Model, rule: Rule = Rule()) -> DataFrame:
    """The documents in the learned languages, one or several: those with a letter whose letter triples are, on average, more
    likely in the languages of their spans than if all triples were equally likely. Texts without letters, in scripts that no
    language uses, and of letters in no order go. All columns stay; the rows do not move."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")
    chance = -GRAM_BITS * np.log(2)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                found = _label(shared.value, [t or "" for t in part.column(text).to_pylist()], rule.switch)
                yield part.filter(pa.array([lang != UNKNOWN and fit > chance for lang, _, _, fit in found], pa.bool_()))

    return docs.mapInArrow(each, docs.schema)
