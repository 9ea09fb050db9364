"""Log-likelihood of whole documents under a gated recurrent language model."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import stored

#: The end of a text, as a word: no word is empty.
END = b""
#: Distinct words a counting task holds before it sends them on.
COUNTED = 200_000
#: Tokens that are scored together, and the number of texts that run side by side.
SCORED = 4_000_000
LANES = 512
#: Tokens whose texts a fit deals to lanes at a time.
FITTED = 6_000_000
#: Added to running means, which would otherwise fade to numbers that processors handle slowly.
FAINT = np.float32(1e-25)


@dataclass(frozen=True)
class Shape:
    """head: the most frequent words, which the output softmax tells apart, in head_classes classes. tails: classes
    of all other words by their shape; within one, a word's share is its smoothed count. known: words whose counts
    travel with the model. rounds: slices of the training documents, dealt by a hash; each is fitted once, in a round of
    its own, after which the tasks' weights are averaged. lanes: texts that run side by side. window: steps that
    gradients reach back; the state runs on through a whole text."""

    hidden: int = 16
    head: int = 1024
    head_classes: int = 32
    tails: int = 15
    known: int = 100_000
    rounds: int = 2
    lanes: int = 1024
    window: int = 12
    rate: float = 0.02


@dataclass
class Weights:
    """x: what each input adds to the gates; u: hidden to gates; cw, cb: hidden to classes; ww, wb: to the words of each
    head class."""

    x: np.ndarray
    u: np.ndarray
    cw: np.ndarray
    cb: np.ndarray
    ww: np.ndarray
    wb: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def pack(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def unpack(self, flat: np.ndarray) -> Weights:
        at, out = 0, []
        for p in self.parts():
            out.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Weights(*out)


@dataclass
class Vocabulary:
    """number: of the known words, most frequent first, so the head comes first. counts: of those. total, distinct: of
    all training tokens. tail_of: class of a shape; tail_counts, tail_words: tokens and distinct words of each
    tail class. inputs: of the known words, as a Reader finds them; kept here so that tasks need not."""

    number: dict[bytes, int]
    counts: np.ndarray
    total: int
    distinct: int
    n_head: int
    tail_of: dict[bytes, int]
    tail_counts: np.ndarray
    tail_words: np.ndarray
    inputs: np.ndarray | None = None


def shape_of(word: bytes) -> bytes:
    """Last letter, the mark after it, and whether there is any byte beyond ASCII."""
    rest = word.rstrip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    mark = word[-1:] if len(rest) < len(word) else b""
    last = rest[-1:] if rest[-1:].isalpha() else b"0" if rest[-1:].isdigit() else b"~" if rest else b"-"
    return last + mark + (b"" if word.isascii() else b"+")


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all whole texts, the end of each counted as a word. Tasks count before they send."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for text in batch.column(0):
                raw = text.as_py() or b""
                held.update(raw.lower().split())
                held[END] += 1
                if len(held) >= COUNTED:
                    yield out()
        yield out()

    return docs.select(F.col("text").cast("binary")).mapInArrow(each, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, shape: Shape) -> Vocabulary:
    """What scoring needs of the counts, which may be many: totals, the known words, and sums by shape of the others."""
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # The least count that at most ``known`` words reach, from a histogram of counts.
    steps = counts.groupBy(F.floor(F.log2("n") * 16).cast("int").alias("step")).agg(F.count("*").alias("k"), F.min("n").alias("n"))
    least, words = None, 0
    for row in sorted(steps.collect(), key=lambda r: -r.step):
        words += row.k
        if words > shape.known:
            break
        least = row.n
    top = counts.filter(F.col("n") >= least).collect() if least is not None else []
    top = sorted(((r.n, bytes(r.word)) for r in top), key=lambda x: (-x[0], x[1]))
    n_head = min(shape.head, len(top))
    head = {w for _, w in top[:n_head]}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()
        k: Counter[bytes] = Counter()
        for batch in batches:
            for word, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if word not in head:
                    s = shape_of(word)
                    n[s] += count
                    k[s] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([k[s] for s in n], pa.int64())], names=["shape", "n", "k"])

    shapes = counts.mapInArrow(each, "shape binary, n long, k long").groupBy("shape").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    rows = sorted(((r.n, bytes(r.shape), r.k) for r in shapes.collect()), key=lambda x: (-x[0], x[1]))
    tail_counts, tail_words = (np.zeros(shape.tails + 1, dtype=np.int64) for _ in range(2))
    tail_of = {}
    for i, (n, s, k) in enumerate(rows):
        c = tail_of[s] = min(i, shape.tails)  # rare shapes, and new ones, share the last class
        tail_counts[c] += n
        tail_words[c] += k
    return Vocabulary(
        {w: i for i, (_, w) in enumerate(top)}, np.array([n for n, _ in top], dtype=np.int64), sums.n, sums.v, n_head, tail_of, tail_counts, tail_words
    )


def first_weights(v: Vocabulary, shape: Shape) -> Weights:
    """Weights whose biases give every class and head word its part of the training tokens, whatever came before."""
    rng = np.random.default_rng(1)
    per = -(-shape.head // shape.head_classes)
    head = np.zeros(shape.head_classes * per)
    head[: v.n_head] = v.counts[: v.n_head]
    head = head.reshape(shape.head_classes, per)
    classes = np.concatenate([head.sum(axis=1), v.tail_counts]) + 0.5
    normal = lambda *size: rng.normal(0, 0.1, size).astype(np.float32)
    h = shape.hidden
    return Weights(
        normal(shape.head_classes * per + shape.tails + 1, 3 * h),
        normal(h, 3 * h),
        np.zeros((h, len(classes)), dtype=np.float32),
        np.log(classes / classes.sum()).astype(np.float32),
        np.zeros((shape.head_classes, h, per), dtype=np.float32),
        np.log((head + 1e-6) / (head + 1e-6).sum(axis=1, keepdims=True)).astype(np.float32),
    )


class _Numbers(dict):
    """Numbers of words: the known ones first, others in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Reader:
    """Texts as numbers of words, and of the inputs and classes that the model sees."""

    def __init__(self, v: Vocabulary, shape: Shape) -> None:
        self.v, self.shape = v, shape
        self.per = -(-shape.head // shape.head_classes)
        self.slots = self.per * shape.head_classes
        self.input = np.zeros(0, dtype=np.int32) if v.inputs is None else v.inputs
        self.reset()
        self.inputs()

    def reset(self) -> None:
        """Forget the words that are not known."""
        self.number = _Numbers(self.v.number)
        self.input = self.input[: len(self.number)]

    def tokens(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        words.append(END)
        return np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))

    def inputs(self) -> np.ndarray:
        """For each word's number its input: its own slot for a head word, that of its tail class for others."""
        words = list(self.number)
        last = self.shape.tails
        more = [i if i < self.v.n_head else self.slots + self.v.tail_of.get(shape_of(words[i]), last) for i in range(len(self.input), len(words))]
        self.input = np.concatenate([self.input, np.array(more, dtype=np.int32)])
        return self.input


def _lanes(lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Lane and first step of each text: the longest texts first, each to the lane that is free first."""
    free = [(0, i) for i in range(n)]
    lane, start = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        at, k = heapq.heappop(free)
        lane[i], start[i] = k, at
        heapq.heappush(free, (at + int(lengths[i]), k))
    return lane, start, max(at for at, _ in free)


def _grid(texts: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps by lanes: word number (-1: nothing), text number, and whether a text begins."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    lane, start, steps = _lanes(lengths, n)
    word = np.full((steps, n), -1, dtype=np.int32)
    text = np.zeros((steps, n), dtype=np.int32)
    begin = np.zeros((steps, n), dtype=bool)
    for i, t in enumerate(texts):
        word[start[i] : start[i] + len(t), lane[i]] = t
        text[start[i] : start[i] + len(t), lane[i]] = i
    begin[start, lane] = True
    return word, text, begin


def _sigmoid(x: np.ndarray) -> np.ndarray:
    y = np.negative(x, out=x)
    np.exp(y, out=y)
    y += 1
    return np.reciprocal(y, out=y)


def _step(w: Weights, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of the gated unit: update gate z, reset gate r, new content n. Lanes run along the last axis, so that gates are
    whole blocks of memory."""
    k = len(h)
    a, g = np.ascontiguousarray(w.x[x].T), w.u.T @ h
    zr = _sigmoid(a[: 2 * k] + g[: 2 * k])
    z, r, m = zr[:k], zr[k:], g[2 * k :]
    n = r * m
    n += a[2 * k :]
    np.tanh(n, out=n)
    now = h - n
    now *= z
    now += n
    return now, z, r, n, m


def _inputs(target: np.ndarray, begin: np.ndarray, end: int) -> np.ndarray:
    """The input of a step is the token before it; a text begins after an end."""
    x = np.full(target.shape, end, dtype=np.int32)
    x[1:] = target[:-1]
    x[begin | (x < 0)] = end
    return x


def _add_rows(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Adds values to the rows they are for, those of one row summed first."""
    order = np.argsort(rows, kind="stable")
    starts = np.flatnonzero(np.diff(rows[order], prepend=-1))
    into[rows[order[starts]]] += np.add.reduceat(values[order], starts, axis=0)


def _output_grads(w: Weights, hs: np.ndarray, y: np.ndarray, shape: Shape, per: int, scale: np.float32) -> tuple[np.ndarray, list[np.ndarray]]:
    """Gradients of the loss by the states, and by cw, cb, ww and wb. States are taken in the order of their classes."""
    hc = shape.head_classes
    cls = np.where(y < hc * per, y // per, hc + y - hc * per)
    order = np.argsort(cls, kind="stable")
    hs, y, cls = hs[order], y[order], cls[order]
    p = hs @ w.cw
    p += w.cb
    np.exp(np.minimum(p, 30, out=p), out=p)
    p *= scale / p.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), cls] -= scale
    dh = p @ w.cw.T
    gw, gb = np.zeros_like(w.ww), np.zeros_like(w.wb)
    cuts = np.searchsorted(cls, np.arange(hc + 1))
    for c in range(hc):
        rows = slice(cuts[c], cuts[c + 1])
        if cuts[c] < cuts[c + 1]:
            q = hs[rows] @ w.ww[c]
            q += w.wb[c]
            np.exp(np.minimum(q, 30, out=q), out=q)
            q *= scale / q.sum(axis=1, keepdims=True)
            q[np.arange(len(q)), y[rows] - c * per] -= scale
            gw[c], gb[c] = hs[rows].T @ q, q.sum(axis=0)
            dh[rows] += q @ w.ww[c].T
    back = np.empty_like(dh)
    back[order] = dh
    return back, [hs.T @ p, p.sum(axis=0), gw, gb]


def _fit(w: Weights, texts: list[np.ndarray], reader: Reader, shape: Shape, rate: float) -> tuple[Weights, int]:
    """Truncated backpropagation: the state is carried from window to window of a whole text, gradients stay within one.
    Lanes whose texts are at an end drop out, so a very long text runs on in a narrow grid with longer windows."""
    lanes = min(shape.lanes, len(texts))
    word, _, begin = _grid(texts, lanes)
    lookup = reader.inputs()
    target = np.where(word >= 0, lookup[np.maximum(word, 0)], -1)
    x = _inputs(target, begin, int(lookup[reader.v.number[END]]) if END in reader.v.number else reader.slots)
    k, per = shape.hidden, reader.per
    parts = w.parts()
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    h = np.zeros((k, lanes), dtype=np.float32)
    scale = np.float32(1 / (lanes * shape.window))  # a narrow grid moves the weights less
    ends = len(word) - (word[::-1] >= 0).argmax(axis=0)
    one = np.float32(1)
    t0 = done = 0
    while t0 < len(word):
        live = ends > t0
        whole = live.all()
        # about as many tokens in a window of a narrow grid, up to eight times the steps
        part = slice(t0, t0 + shape.window * min(8, max(1, lanes // int(live.sum()))))
        t0, done = part.stop, done + 1
        xs, ys, bs = (v[part] if whole else v[part][:, live] for v in (x, target, begin))
        now = h if whole else h[:, live]
        starts = bs.any(axis=1)
        saved = []
        states = np.empty((len(xs), k, now.shape[1]), dtype=np.float32)
        for i in range(len(xs)):
            if starts[i]:
                now = np.where(bs[i], np.float32(0), now)
            before = now
            now, z, r, n, m = _step(w, before, xs[i])
            saved.append((before, z, r, n, m))
            states[i] = now
        if whole:
            h = now
        else:
            h[:, live] = now
        y = ys.ravel()
        some = np.flatnonzero(y >= 0)
        flat = states.transpose(0, 2, 1).reshape(-1, k)
        full = np.zeros_like(flat)
        full[some], outer = _output_grads(w, flat[some], y[some], shape, per, scale)
        full = np.ascontiguousarray(full.reshape(len(xs), -1, k).transpose(0, 2, 1))
        gu = np.zeros_like(w.u)
        later = np.zeros_like(now)
        da = np.empty((len(xs), 3 * k, now.shape[1]), dtype=np.float32)
        dg = np.empty((3 * k, now.shape[1]), dtype=np.float32)
        for i in range(len(xs) - 1, -1, -1):
            before, z, r, n, m = saved[i]
            d = full[i] + later
            dn = d * (one - z)
            dz = d * (before - n)
            dz *= z
            dz *= one - z
            dn *= one - n * n
            dr = dn * m
            dr *= r
            dr *= one - r
            dg[:k], dg[k : 2 * k] = dz, dr
            da[i, : 2 * k], da[i, 2 * k :] = dg[: 2 * k], dn
            np.multiply(dn, r, out=dg[2 * k :])
            gu += before @ dg.T
            later = w.u @ dg
            d *= z
            later += d
            if starts[i]:
                later[:, bs[i]] = 0
        gx = np.zeros_like(w.x)
        _add_rows(gx, xs.ravel(), da.transpose(0, 2, 1).reshape(-1, 3 * k))
        # Adam; rarely used rows move little because their first moments are near zero
        step = np.float32(rate * np.sqrt(1 - 0.99**done) / (1 - 0.9**done))
        for q, g, a, b in zip(parts, (gx, gu, *outer), first, second):
            a += np.float32(0.1) * (g - a) + FAINT
            b += np.float32(0.01) * (g * g - b) + FAINT
            q -= step * a / (np.sqrt(b) + np.float32(1e-7))
    return w, int((word >= 0).sum())


def _log_share(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log of the softmax at one place of each row."""
    np.minimum(logits, 30, out=logits)
    own = logits[np.arange(len(at)), at]
    return own - np.log(np.exp(logits, out=logits).sum(axis=1))


def _likelihood(w: Weights, texts: list[np.ndarray], reader: Reader, shape: Shape) -> np.ndarray:
    """Natural log probability of each text's tokens, a tail word standing for its class. The state of a text runs
    through all its windows."""
    lanes = min(LANES, len(texts))
    word, text, begin = _grid(texts, lanes)
    lookup = reader.inputs()
    target = np.where(word >= 0, lookup[np.maximum(word, 0)], -1)
    x = _inputs(target, begin, int(lookup[reader.v.number[END]]) if END in reader.v.number else reader.slots)
    per, hc = reader.per, shape.head_classes
    out = np.zeros(len(texts))
    h = np.zeros((shape.hidden, lanes), dtype=np.float32)
    any_ = word >= 0
    width = any_.sum(axis=1)  # lanes that end are not all at the right, so only whole steps shrink
    for t0 in range(0, len(word), 64):
        t1 = min(len(word), t0 + 64)
        live = np.flatnonzero(any_[t0:t1].any(axis=0)) if width[t0] < lanes else None
        states = []
        part = h if live is None else h[:, live]
        xs, bs = (v[t0:t1] if live is None else v[t0:t1, live] for v in (x, begin))
        starts = bs.any(axis=1)
        for i in range(t1 - t0):
            if starts[i]:
                part = np.where(bs[i], np.float32(0), part)
            part = _step(w, part, xs[i])[0]
            states.append(part.T)
        if live is None:
            h = part
        else:
            h[:, live] = part
        y = (target[t0:t1] if live is None else target[t0:t1, live]).ravel()
        doc = (text[t0:t1] if live is None else text[t0:t1, live]).ravel()
        some = np.flatnonzero(y >= 0)
        y, doc, hs = y[some], doc[some], np.concatenate(states)[some]
        cls = np.where(y < hc * per, y // per, hc + y - hc * per)
        order = np.argsort(cls, kind="stable")
        y, doc, hs, cls = y[order], doc[order], hs[order], cls[order]
        got = _log_share(hs @ w.cw + w.cb, cls)
        cuts = np.searchsorted(cls, np.arange(hc + 1))
        for c in range(hc):
            rows = slice(cuts[c], cuts[c + 1])
            if cuts[c] < cuts[c + 1]:
                got[rows] += _log_share(hs[rows] @ w.ww[c] + w.wb[c], y[rows] - c * per)
        out += np.bincount(doc, weights=got, minlength=len(texts))
    return out


def _fit_all(w: Weights, raw: Iterator[bytes | None], reader: Reader, shape: Shape, rate: float, most: int = FITTED) -> tuple[Weights, int]:
    """All texts once, whole, about ``most`` tokens at hand at a time."""
    texts, held, done = [], 0, 0
    for t in raw:
        texts.append(reader.tokens(t))
        held += len(texts[-1])
        if held >= most:
            w, n = _fit(w, texts, reader, shape, rate)
            texts, held, done = [], 0, done + n
            reader.reset()
    if texts:
        w, n = _fit(w, texts, reader, shape, rate)
        done += n
    return w, done


def fit(docs: DataFrame, v: Vocabulary, shape: Shape) -> Weights:
    """Weights after ``rounds`` rounds: in each, every task fits its own part of the round's slice of the documents, starting
    from the same weights, and the results are averaged by their tokens, in a few streams before the driver sees them.
    Every document is in one slice."""
    weights = first_weights(v, shape)
    context = docs.sparkSession.sparkContext
    schema = "n long, weights binary"
    for r in range(shape.rounds):
        shared = context.broadcast((weights, v))
        rate = shape.rate / (1 + r)

        def each(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate) -> Iterator[pa.RecordBatch]:
            weights, v = shared.value
            reader = Reader(v, shape)
            texts = (t.as_py() for batch in batches for t in batch.column(0))
            w, n = _fit_all(Weights(*[p.copy() for p in weights.parts()]), texts, reader, shape, rate)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([w.pack().astype(np.float32).tobytes()])], names=["n", "weights"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = 0.0, 0
            for batch in batches:
                for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    total = total + k * np.frombuffer(packed, dtype=np.float32).astype(np.float64)
                    n += k
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([(total / n).astype(np.float32).tobytes()])], names=["n", "weights"])

        drawn = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(shape.rounds)) == r).select(F.col("text").cast("binary"))
        got = drawn.mapInArrow(each, schema).repartition(8).mapInArrow(add, schema).collect()
        n = sum(x.n for x in got)
        if n:
            flat = sum(x.n * np.frombuffer(x.weights, dtype=np.float32).astype(np.float64) for x in got) / n
            weights = weights.unpack(flat)
    return weights


PASS = (
    "key long, doc_id long, held_out boolean, n_tokens long, known long, logs double, model double, "
    "rare array<struct<word:binary,n:int>>"
)


def score(docs: DataFrame, held_out: Column, shape: Shape = Shape()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Words are separated by white space and lower-cased (A-Z); a text ends with one more token. The model learns from
    rows whose held_out is false. A token's probability is that of its class, given the state, times that of the word
    in the class: a second softmax for the most frequent words; for all others a class is a shape, and the word has its
    smoothed count in the class, one more slot being that of all words never seen. Counts of the words that travel with
    the model are at hand; those of rarer words are joined, so the whole count table is used but never held in one place.
    A null text is an empty one: one token. A null doc_id is answered like any other. Rows that repeat are answered each by
    itself. Without training rows every score is finite and train_tokens is 0. Other columns are left out.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    train = rows.filter("not held_out")
    counts = stored(count_words(train), "word_counts")
    v = vocabulary(counts, shape)
    v.inputs = Reader(v, shape).input
    weights = fit(train, v, shape)
    shared = docs.sparkSession.sparkContext.broadcast((weights, v))  # bounded by shape

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, v = shared.value
        reader = Reader(v, shape)
        log_count = np.log10(v.counts + 1.0)
        tail_log = np.log10(v.tail_counts + v.tail_words + 1.0)
        n_known = len(v.counts)
        pair = pa.struct([("word", pa.binary()), ("n", pa.int32())])

        def out(meta: list[tuple], texts: list[np.ndarray]) -> pa.RecordBatch:
            model = _likelihood(weights, texts, reader, shape) / np.log(10)
            lookup = reader.inputs()
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            flat, doc = np.concatenate(texts), np.repeat(np.arange(len(texts)), sizes)
            known = flat < n_known
            logs = np.bincount(doc[known], weights=log_count[flat[known]], minlength=len(texts))
            # a tail word's share of its class: the count of a known one is at hand, that of the others is joined later
            entry = lookup[flat]
            tail = entry >= reader.slots
            model -= np.bincount(doc[tail], weights=tail_log[entry[tail] - reader.slots], minlength=len(texts))
            both = tail & known
            model += np.bincount(doc[both], weights=log_count[flat[both]], minlength=len(texts))
            rare, n = np.unique(doc[~known].astype(np.int64) << 32 | flat[~known], return_counts=True)
            words = pa.array(list(reader.number), pa.binary())
            offsets = np.concatenate([[0], np.cumsum(np.bincount(rare >> 32, minlength=len(texts)))])
            items = pa.StructArray.from_arrays([words.take(pa.array(rare & 0xFFFFFFFF)), pa.array(n.astype(np.int32))], fields=list(pair))
            key, ids, held = zip(*meta)
            made = pa.RecordBatch.from_arrays(
                [
                    pa.array(key, pa.int64()), pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(sizes),
                    pa.array(np.bincount(doc[known], minlength=len(texts)), pa.int64()), pa.array(logs.astype(float)), pa.array(model.astype(float)),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), items),
                ],
                names=[x.split()[0] for x in PASS.split(", ")],
            )
            reader.reset()
            return made

        meta, texts, held = [], [], 0
        for batch in batches:
            for key, i, h, text in zip(*(batch.column(c) for c in range(4))):
                texts.append(reader.tokens(text.as_py()))
                meta.append((key.as_py(), i.as_py(), h.as_py()))
                held += len(texts[-1])
                if held >= SCORED:
                    yield out(meta, texts)
                    meta, texts, held = [], [], 0
        if texts:
            yield out(meta, texts)

    passed = stored(rows.select(F.xxhash64("doc_id", "text", "held_out").alias("key"), "doc_id", "held_out", "text").mapInArrow(each, PASS), "scored")
    # rows that repeat share a key: their sums are taken together and divided
    rare = passed.select("key", F.inline("rare")).join(counts.withColumnRenamed("n", "c"), "word", "left")
    sums = rare.groupBy("key").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("found")
    )
    times = passed.groupBy("key").agg(F.count("*").alias("times"))
    looked = times.join(sums, "key", "left").select(
        "key",
        (F.coalesce("more", F.lit(0.0)) / F.col("times")).alias("more"),
        (F.coalesce("found", F.lit(0)) / F.col("times")).cast("long").alias("found"),
    )
    return passed.drop("rare").join(looked, "key").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("found")).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("more") - F.col("n_tokens") * F.log10(F.lit(float(v.total + v.distinct + 1)))).alias("base_score"),
        (F.col("model") + F.col("more")).alias("score"),
    )
