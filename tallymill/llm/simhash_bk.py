"""Near-duplicate documents by SimHash, linked through BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.common import components, mix64, stored

BITS = 64
#: Rows of a shard that one BK-tree holds; a larger shard is dealt in blocks, and every pair of blocks meets once.
TREE_ROWS = 512
SEED = 42


#: Shingles hashed at a time.
SHINGLES = 65_536


def _shingles(tokens: list[bytes], width: int) -> Iterator[np.ndarray]:
    """XXH64 values of all word shingles, so many at a time. Fewer words make one shingle, the whole word sequence."""
    n = len(tokens)
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    total = max(1, n - width + 1) if n else 0
    for lo in range(0, total, SHINGLES):
        hi = min(total, lo + SHINGLES)
        pairs = zip(starts[lo:hi].tolist(), ends[min(lo + width, n) - 1 : hi + width - 1].tolist())
        yield np.array([digest(joined[a:b], SEED) for a, b in pairs], dtype="<u8")


def _odd(n: int) -> np.ndarray:
    """Odd factors; each deals 64-bit values in an order of its own."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def fingerprint(text: bytes, width: int, anchors: int = 0) -> tuple[int, list[int]]:
    """SimHash of a text's word shingles: a bit is set that is set in over half of their XXH64 values. A text of fewer
    words has one shingle, its whole word sequence; a text without words has fingerprint zero. Also its ``anchors``, each a
    hash of the smallest shingles in two orders."""
    tokens = text.lower().split()
    if not tokens:
        return 0, [0] * anchors
    count = np.zeros(BITS, dtype=np.int64)
    odd = _odd(2 * anchors)
    least = np.full(2 * anchors, np.iinfo(np.uint64).max, dtype=np.uint64)
    total = 0
    for values in _shingles(tokens, width):
        total += len(values)
        count += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        for lo in range(0, len(values) if anchors else 0, 4096):
            least = np.minimum(least, (values[lo : lo + 4096, None] * odd).min(axis=0))
    bits = np.packbits((2 * count > total).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0]), mix64(mix64(least[:anchors]) + least[anchors:]).tolist()


def shingle_counts(text: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text, in order, and how often each occurs."""
    found = list(_shingles(text.lower().split(), width))
    values, counts = np.unique(np.concatenate(found) if found else np.zeros(0, dtype="<u8"), return_counts=True)
    return values, counts.astype(np.float64)


def cosine_of(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Cosine of two texts' shingle counts, zero for a text without words."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    dot = float((a[1] * b[1][at])[b[0][at] == a[0]].sum())
    return dot / float(np.sqrt((a[1] @ a[1]) * (b[1] @ b[1])))


def fingerprints(docs: DataFrame, width: int = 5, anchors: int = 0) -> DataFrame:
    """(doc_id, fingerprint) of every row, as signed 64-bit integers. With anchors also those, a hash of the text, the node
    (zero for all texts without words), and the bytes of the text."""
    schema = "doc_id long, fingerprint long" + (", anchors array<long>, node long, size long" if anchors else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                texts = [x or b"" for x in part.column(1).to_pylist()]
                found, least = zip(*[fingerprint(x, width, anchors) for x in texts])
                columns = [part.column(0), pa.array(np.array(found, dtype=np.uint64).view(np.int64))]
                if anchors:
                    ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * anchors)
                    flat = pa.array(np.array(least, dtype=np.uint64).ravel().view(np.int64))
                    node = [n if any(a) else 0 for n, a in zip(part.column(2).to_pylist(), least)]
                    columns += [pa.ListArray.from_arrays(ends, flat), pa.array(node, pa.int64()), pa.array([len(x) for x in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    text = F.col("text").cast("binary")
    return docs.select(F.col("doc_id").cast("long"), text, *([node_of(text)] if anchors else [])).mapInArrow(each, schema)


def node_of(text: Column) -> Column:
    """What equal texts have in common."""
    return F.xxhash64(F.coalesce(text, F.lit(b""))).alias("node")


class BKTree:
    """Integers under Hamming distance. A child hangs from its parent by its distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at = 0
        if self.values:
            while True:
                d = (value ^ self.values[at]).bit_count()
                below = self.children[at].get(d)
                if below is None:
                    self.children[at][d] = len(self.values)
                    break
                at = below
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        """Numbers, in order of addition, of the values within the radius: a child at distance c from its parent is
        followed only if c differs from the query's distance by the radius at most."""
        found, open_ = [], [0] if self.values else []
        while open_:
            at = open_.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(at)
            open_ += [child for c, child in self.children[at].items() if d - radius <= c <= d + radius]
        return found


def bands(radius: int, agree: int = 2) -> list[int]:
    """Masks of bits such that two fingerprints within the radius agree on all bits of at least one mask: of
    radius + agree bands of bits, the radius can spoil only ``radius``."""
    n = radius + agree
    edges = [BITS * i // n for i in range(n + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(x) for x in combinations(parts, agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _close(values: list[int], split: int, radius: int) -> Iterator[tuple[int, int]]:
    """Numbers of the values that are within the radius of each other. The first ``split`` values build the tree; the
    others ask it, and also enter it if split is 0 (then the values meet each other)."""
    tree = BKTree()
    for v in values[:split]:
        tree.add(v)
    for i in range(split, len(values)):
        for j in tree.within(values[i], radius):
            yield i, j
        if not split:
            tree.add(values[i])


class _Roots(dict):
    """Groups that are joined step by step."""

    def find(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = x = self.get(up, up)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self[max(a, b)] = min(a, b)
        return a != b


def _linked(values: list[int], split: int, radius: int) -> list[tuple[int, int]]:
    """A forest of links that joins what the pairs within the radius join."""
    root = _Roots()
    return [(values[i], values[j]) for i, j in _close(values, split, radius) if root.join(i, j)]


def links(found: DataFrame, radius: int, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join the ones within the radius of each other.

    found: distinct fingerprints. They are dealt to shards by the bits of each mask of ``bands``, which loses no pair; one
    BK-tree a shard.
    A tree grows with the corpus, so it is not broadcast: queries travel to the shard they can match in. A shard over
    ``tree_rows`` is dealt in blocks by a hash, and each pair of blocks is one task's tree and its queries. Within a
    shard only the links that join two groups are returned, at most one a row.
    """
    value = F.col("fingerprint")
    shards = [F.struct(F.lit(i).alias("mask"), value.bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(bands(radius))]
    keyed = found.select("fingerprint", F.inline(F.array(*shards)))
    crowded = keyed.groupBy("mask", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    n_blocks = F.ceil(F.col("n") / tree_rows).cast("int")
    block = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    dealt = (
        keyed.join(crowded.select("mask", "bits", n_blocks.alias("blocks")), ["mask", "bits"])
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "mask",
            "bits",
            F.least("block", "other").alias("low"),
            F.greatest("block", "other").alias("high"),
            (F.col("block") > F.col("other")).cast("int").alias("asks"),
            "fingerprint",
        )
        .repartition("mask", "bits", "low", "high")
        .sortWithinPartitions("mask", "bits", "low", "high", "asks", "fingerprint")
    )

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, tree, queries = None, [], []

        def out() -> list[tuple[int, int]]:
            if shard is None or len(tree) + len(queries) < 2:
                return []
            same = shard[2] == shard[3]
            return _linked(tree + queries, 0 if same else len(tree), radius) if same or tree else []

        made: list[tuple[int, int]] = []
        for batch in batches:
            low = batch.fingerprint.to_numpy().view(np.uint64).tolist()
            for key, asks, v in zip(zip(batch["mask"], batch["bits"], batch["low"], batch["high"]), batch["asks"], low):
                if key != shard:
                    made += out()
                    shard, tree, queries = key, [], []
                (queries if asks else tree).append(v)
            if made:
                yield pd.DataFrame(np.array(made, dtype=np.uint64).view(np.int64), columns=["a", "b"])
                made = []
        made += out()
        if made:
            yield pd.DataFrame(np.array(made, dtype=np.uint64).view(np.int64), columns=["a", "b"])

    return dealt.mapInPandas(each, "a long, b long").distinct()


GROUP = ["mask", "bits", "low", "high"]
ENTRY = [*GROUP, "asks", "node", "fingerprint", "team"]
#: Texts of a block have about so many bytes at most, or it is one text.
BLOCK_BYTES = 4 << 20
#: Anchors by which all texts meet. Those that the first ones did not join meet by the others too.
FIRST_ANCHORS = 2


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of one pair of blocks after another, from a stream that is sorted by them."""
    shard, held = None, []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if row[:4] != shard:
                if len(held) > 1:
                    yield held
                shard, held = row[:4], []
            held.append(row)
    if len(held) > 1:
        yield held


def _settle(rows: list[tuple], width: int, radius: int, cosine: float) -> list[tuple[int, int]]:
    """Links of a pair of blocks, at most one a row: the rows of one block build a BK-tree and the others ask it, or all rows
    of a single block ask it one after the other. A candidate within the radius that is not of the asking row's
    team is settled by the cosine of the texts, and teams that are linked become one."""
    root, made, counts = _Roots(), [], {}
    values = [r[6] & ((1 << 64) - 1) for r in rows]
    split = 0 if rows[0][2] == rows[0][3] else sum(not r[4] for r in rows)
    tree = BKTree()
    for v in values[:split]:
        tree.add(v)
    teams = {r[7] for r in rows[:split]}

    def count(k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in counts:
            counts[k] = shingle_counts(rows[k][8], width)
        return counts[k]

    for i in range(split, len(rows)):
        own = rows[i][7]
        if len(teams) != 1 or root.find(own) != root.find(next(iter(teams))):
            for j in tree.within(values[i], radius):
                if root.find(own) != root.find(rows[j][7]) and cosine_of(count(i), count(j)) >= cosine - 1e-12:
                    root.join(own, rows[j][7])
                    made.append((rows[i][5], rows[j][5]))
        if not split:
            tree.add(values[i])
            teams.add(own)
    return made


def similar(dealt: DataFrame, texts: DataFrame, width: int, radius: int, cosine: float) -> DataFrame:
    """Links (a, b) between nodes of different teams in one pair of blocks whose shingle counts have the cosine at least.
    Pairs of blocks that hold one team only are left out, and only texts of the others travel. texts: node, text."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batch.slice(i, 64) for batch in batches for i in range(0, batch.num_rows, 64)):
            made = _settle(rows, width, radius, cosine)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*made)], names=["a", "b"])

    several = dealt.groupBy(*GROUP).agg(F.min("team").alias("a"), F.max("team").alias("b")).filter("a < b").select(*GROUP)
    asked = stored(dealt.join(several, GROUP).select(*ENTRY), "candidates")
    needed = texts.join(asked.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    joined = asked.join(needed, "node").select(*ENTRY, "text")
    order = [*GROUP, "asks", "node"]
    return stored(joined.repartition(*GROUP).sortWithinPartitions(*order).mapInArrow(settle, "a long, b long"), "similar")


def anchored_links(
    rows: DataFrame, texts: DataFrame, width: int, radius: int, cosine: float, block_rows: int = TREE_ROWS, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Links (a, b) that join the nodes with a cosine of their shingle counts, out of those that share an anchor and are
    within the radius.

    rows: node, fingerprint, anchors and size of every text; texts: node, text. Nodes are dealt to shards by each of their anchors,
    and a shard that is too large to blocks by a hash. First the nodes of a block meet by a few anchors, which joins most
    copies. Then the blocks of every shard that holds more than one component meet in pairs.
    """
    nodes = rows.groupBy("node").agg(F.min("fingerprint").alias("fingerprint"), F.min("anchors").alias("anchors"), F.max("size").alias("size"))
    keyed = nodes.select("node", "fingerprint", "size", F.posexplode("anchors").alias("mask", "bits"))
    crowded = keyed.groupBy("mask", "bits").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).filter("n > 1")
    n_blocks = F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("bytes") / block_bytes)).cast("int").alias("blocks")
    placed = stored(
        keyed.join(crowded.select("mask", "bits", n_blocks), ["mask", "bits"])
        # one hash for each mask, so that blocks of one shard are joined through those of another
        .withColumn("block", F.pmod(F.xxhash64("node", "mask"), F.col("blocks")).cast("int"))
        .select("mask", "bits", "node", "fingerprint", "block", "blocks"),
        "anchored",
    )
    block = F.col("block")
    first = placed.filter(F.col("mask") < FIRST_ANCHORS).select(
        "mask", "bits", block.alias("low"), block.alias("high"), F.lit(0).alias("asks"), "node", "fingerprint", F.col("node").alias("team")
    )
    found = similar(first, texts, width, radius, cosine)
    teamed = placed.join(components(found), "node", "left").withColumn("team", F.coalesce("component", "node"))
    several = teamed.groupBy("mask", "bits").agg(F.min("team").alias("a"), F.max("team").alias("b")).filter("a < b")
    pairs = (
        teamed.join(several.select("mask", "bits"), ["mask", "bits"])
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .filter((F.col("mask") >= FIRST_ANCHORS) | (block != F.col("other")))
        .select(
            "mask", "bits", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
            (block > F.col("other")).cast("int").alias("asks"), "node", "fingerprint", "team",
        )
    )
    return found.unionByName(similar(pairs, texts, width, radius, cosine))


def near_duplicates(
    docs: DataFrame, width: int = 5, radius: int = 4, anchors: int = 0, tree_rows: int = TREE_ROWS, cosine: float = 0.8
) -> DataFrame:
    """doc_id, fingerprint (signed 64-bit) and component_id of every row: the smallest doc_id that is reached over
    near duplicates.

    Without anchors these are fingerprints which differ in at most ``radius`` bits. No link is lost, at a cost that rises
    steeply with the radius. With anchors they are texts with a ``cosine`` of their shingle counts, which is computed
    from the texts; fingerprints only choose the candidates. Texts meet if they share one of so many anchors, the smallest of
    their shingles in two orders, and are within the radius: of those that have a part s of their distinct shingles in
    common (Jaccard), (1 - s * s) ** anchors are missed, 1 in 10,000 at 2/3 (two sets of equal size with a cosine of 0.8)
    and 16 anchors; by the binomial law of SimHash, 4 in 10,000 at a cosine of 0.8 are more than 24 bits apart.
    Null and empty texts have fingerprint zero and are linked like others. Rows that repeat, or share a fingerprint
    (with anchors: the text) otherwise, are one node, so groups of copies never meet row by row. A null doc_id
    gets an answer but names no component unless all of its component are null. An empty table gives an empty one; other
    columns are left out.
    """
    rows = stored(fingerprints(docs, width, anchors), "fingerprints")
    key = "node" if anchors else "fingerprint"
    nodes = stored(rows.groupBy(F.col(key).alias("own")).agg(F.min("doc_id").alias("least")), "fingerprint_nodes")
    if anchors:
        texts = docs.select(node_of(F.col("text").cast("binary")), F.col("text").cast("binary").alias("text"))
        found = anchored_links(rows, texts, width, radius, cosine, tree_rows)
    else:
        found = links(nodes.select(F.col("own").alias("fingerprint")), radius, tree_rows)
    grouped = nodes.join(components(found).withColumnRenamed("node", "own"), "own", "left").select(
        "own", "least", F.coalesce("component", "own").alias("component")
    )
    named = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = grouped.join(named, "component").select(F.col("own").alias(key), "component_id")
    return rows.select("doc_id", "fingerprint", *([key] if anchors else [])).join(answer, key).select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, width: int = 5, radius: int = 4, anchors: int = 0, cosine: float = 0.8) -> DataFrame:
    """The documents without those that have a near duplicate with a smaller doc_id, and one row for each doc_id. A row
    without doc_id stays. All columns stay."""
    kept = near_duplicates(docs, width, radius, anchors, cosine=cosine).filter("doc_id = component_id").select("doc_id").distinct()
    own = Window.partitionBy("doc_id").orderBy("_order")
    chosen = (
        docs.join(kept, "doc_id", "left_semi")
        .withColumn("_order", F.xxhash64("text"))
        .withColumn("_order", F.row_number().over(own))
        .filter("_order = 1")
        .select(docs.columns)
    )
    return chosen.unionByName(docs.filter("doc_id is null"))
