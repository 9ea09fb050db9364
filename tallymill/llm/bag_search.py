"""Ranked lexical search by bag deduplication.

A document counts for a search only by how often it holds each of the items' terms and by its length norm m. Documents are cut
down to the items' vocabulary, those with the same term counts and the same m are one class, classes are scored once for
all items, and the best classes are expanded to their documents by ascending doc_id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymill.llm.common import mix64, stored

#: Items are searched together as long as their distinct terms and results come to about this many.
BLOCK_UNITS = 200_000
#: Class and item pairs of scores that a task adds up at a time.
PAIRS = 4_000_000

BAGS = "doc_id long, n long, terms array<int>, counts array<int>"
HITS = "item int, score long, doc_id long"
RANKED = "item_id long, rank int, doc_id long, score long"

#: ASCII that is no letter or digit parts terms; A to Z are lowered; all other bytes stay, so no character is cut.
_FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text, both in UTF-8, in order."""
    return text.translate(_FOLD).split()


def weight(n_docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


class Items:
    """The items of a block: their vocabulary, and for each of its terms the items that hold it and how often."""

    def __init__(self, rows: list[tuple[int | None, bytes]]) -> None:
        self.ids = [i for i, _ in rows]
        self.vocabulary: dict[bytes, int] = {}
        entries = []
        for at, (_, text) in enumerate(rows):
            for term, times in Counter(terms_of(text)).items():
                entries.append((self.vocabulary.setdefault(term, len(self.vocabulary)), at, times))
        entries.sort()
        flat = np.array(entries, dtype=np.int64).reshape(-1, 3)
        self.item, self.times = flat[:, 1], flat[:, 2]
        self.starts = np.searchsorted(flat[:, 0], np.arange(len(self.vocabulary) + 1))

    def __len__(self) -> int:
        return len(self.ids)


def bags(docs: DataFrame, shared) -> DataFrame:
    """Per row of docs: doc_id, n (its terms), and the items' terms it holds, as ascending numbers with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.vocabulary
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(1):
                raw = text.as_buffer()
                found = terms_of(raw.to_pybytes()) if raw is not None else []
                held = Counter(filter(known.__contains__, found))
                bag = sorted((known[t], c) for t, c in held.items())
                out.append((len(found), [t for t, _ in bag], [c for _, c in bag]))
            n, terms, counts = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                names=["doc_id", "n", "terms", "counts"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BAGS)


def classes(found: DataFrame, m: Column, top: int) -> DataFrame:
    """One row for each class of equal terms, counts and m, with its ``top`` smallest doc_ids (without one: last).

    Equal hashes bring rows together, equal contents make them a class, so a collision joins nothing. More members than ``top`` can
    never be listed; they leave before the exchange, so a class with a third of all rows is a few rows a task.
    """
    keyed = found.filter(F.size("terms") > 0).select("doc_id", "terms", "counts", m.alias("m"))
    keyed = keyed.withColumn("hash", F.xxhash64("terms", "counts", "m"))
    same = ["hash", "m", "terms", "counts"]
    first = Window.partitionBy(*same).orderBy(F.asc_nulls_last("doc_id"))
    few = keyed.withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= top)
    members = F.transform(F.sort_array(F.collect_list(F.struct("_place", "doc_id"))), lambda x: x["doc_id"])
    return few.groupBy(*same).agg(members.alias("members")).select("m", "terms", "counts", "members")


def _sums(items: Items, weights: np.ndarray, owner: np.ndarray, terms: np.ndarray, counts: np.ndarray, m: np.ndarray) -> tuple:
    """Scores above 0 of classes for items: (class, item, score), in whole numbers."""
    share = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 12 * m[owner]))
    sizes = np.diff(items.starts)[terms]
    at = np.repeat(items.starts[terms] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    pair = np.repeat(owner, sizes) * len(items) + items.item[at]
    value = np.repeat(share, sizes) * items.times[at]
    order = np.argsort(pair, kind="stable")
    pair, value = pair[order], value[order]
    heads = np.flatnonzero(np.diff(pair, prepend=-1))
    score = np.add.reduceat(value, heads) if len(heads) else value
    pair = pair[heads]
    above = score > 0
    return pair[above] // len(items), pair[above] % len(items), score[above]


def hits(found: DataFrame, shared, weights, top: int) -> DataFrame:
    """Per task and item its ``top`` best documents: item, score, doc_id. A task holds as many, whatever it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, w = shared.value, weights.value
        none = np.iinfo(np.int64).max  # rows without a doc_id come last
        best = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)

        def keep(item, score, doc, null):
            """The best so far of each item, and the new ones."""
            item, score, doc, null = (np.concatenate([a, b]) for a, b in zip(best, (item, score, doc, null)))
            order = np.lexsort((doc, null, -score, item))
            item, score, doc, null = item[order], score[order], doc[order], null[order]
            starts = np.flatnonzero(np.diff(item, prepend=-1))
            place = np.arange(len(item)) - np.repeat(starts, np.diff(np.append(starts, len(item))))
            few = place < top
            return item[few], score[few], doc[few], null[few]

        for batch in batches:
            lists = [batch.column(i).combine_chunks() if hasattr(batch.column(i), "combine_chunks") else batch.column(i) for i in (1, 2, 3)]
            terms, counts = lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy().astype(np.int64)
            sizes = lists[0].value_lengths().to_numpy().astype(np.int64)
            ends = np.cumsum(sizes)
            m = batch.column(0).to_numpy()
            member_counts = lists[2].value_lengths().to_numpy().astype(np.int64)
            member_starts = np.cumsum(member_counts) - member_counts
            members = lists[2].flatten()
            missing = members.is_null().to_numpy(zero_copy_only=False)
            members = members.fill_null(none).to_numpy()
            work = np.cumsum(np.diff(items.starts)[terms])
            at = 0
            while at < len(sizes):  # so many classes at a time that their pairs fit
                before = work[ends[at - 1] - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(work[ends - 1], before + PAIRS, "right")))
                lo = ends[at - 1] if at else 0
                part = slice(lo, ends[to - 1])
                owner = np.repeat(np.arange(at, to), sizes[at:to])
                cls, item, score = _sums(items, w, owner, terms[part], counts[part], m)
                each = member_counts[cls]
                place = np.repeat(member_starts[cls] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
                best = keep(np.repeat(item, each), np.repeat(score, each), members[place], missing[place])
                at = to
        item, score, doc, null = best
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), pa.array(score, pa.int64()), pa.array(doc, pa.int64(), mask=null)], names=["item", "score", "doc_id"]
        )

    return found.select("m", "terms", "counts", "members").mapInArrow(run, HITS)


def _search_block(docs: DataFrame, rows: list[tuple[int | None, bytes]], top: int) -> DataFrame:
    spark = docs.sparkSession
    items = Items(rows)
    shared = spark.sparkContext.broadcast(items)  # bounded by BLOCK_UNITS, see search()
    found = stored(bags(docs, shared), "bags")
    totals = found.filter("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    holding = np.zeros(len(items.vocabulary), dtype=np.int64)
    counted = found.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    holding[counted["term"].to_numpy()] = counted["count"].to_numpy()
    weights = spark.sparkContext.broadcast(np.array([weight(totals.docs, h) for h in holding.tolist()], dtype=np.int64))
    # as a decimal, since 25 * n * documents can pass 2^63
    m = F.lit(100 - 25) + F.expr(f"(cast(n as decimal(19,0)) * cast({25 * totals.docs}L as decimal(19,0))) div {max(totals.terms or 0, 1)}L")
    best = hits(classes(found, m, top), shared, weights, top)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = best.withColumn("rank", rank).filter(F.col("rank") <= top)
    names = spark.createDataFrame([(i, x) for i, x in enumerate(items.ids)], "item int, item_id long")
    return ranked.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` documents of highest score for each item: item_id, rank, doc_id, score (above 0; equal ones by doc_id).

    A null or empty text has no term: as a document it counts for nothing, as an item it finds nothing. Each row of
    items is searched by itself and each row of docs is a document, repeats included; a document without doc_id comes
    last among equals. Empty tables give no row; other columns are left out.

    Items are searched in blocks: as many blocks as keep the distinct terms of one near BLOCK_UNITS, dealt by a hash of the row. Only a block's
    items, vocabulary and weights are held by the driver and sent to the executors.
    """
    spark = docs.sparkSession
    given = stored(items.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "items")
    # a term has at least one byte and one that parts it from the next
    units = given.agg(F.sum((F.octet_length("text") + 1) / 2 + top)).first()[0] or 0
    n_blocks = math.ceil(units / BLOCK_UNITS) if units > BLOCK_UNITS else 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    out = spark.createDataFrame([], RANKED)
    for b in range(n_blocks):
        rows = [(r[0], r[1].encode()) for r in given.filter(block == b).collect()]
        rows = [r for r in rows if terms_of(r[1])]
        if rows:
            out = out.unionByName(stored(_search_block(docs, rows, top), "ranked"))
    return out
