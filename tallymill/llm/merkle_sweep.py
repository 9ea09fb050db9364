"""Merkle manifest of a dataset by time-forward processing.

The tree is a graph whose nodes are labelled (level, index): a node's value depends on messages from nodes with smaller
labels. One sweep in ascending order takes the digests that reached a node off a priority queue, and puts the node's own
digest into the queue under its parent's label. The sweep in descending order hands each node the proof from it up to the root, from which it
makes those of its children.

The queue is external. A tree is cut in blocks of 2^SPAN neighbouring nodes of a level, with all above them up to one node:
messages inside a block wait in a heap of at most that many entries, messages that leave it are rows that Spark's exchange
deals to the blocks of the next round, a 2^SPAN-th of the rows of the round before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymill.llm.common import stored

#: A block has 2^SPAN nodes of its lowest level.
SPAN = 9

BLOCKS = "tree string, block long, n long, top binary, digests binary, names array<string>, doc_ids array<long>, altered array<binary>"
#: What a block hands down to a node of its lowest level. steps: the proof from it to the root, one byte that says where
#: the sibling stands, then its digest if there is one. path: roots of the trees on the way, the whole tree's first.
BELOW = "tree string, block long, name string, steps binary, path array<binary>, doc_id long, leaf binary, altered binary"
LEAVES = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, n_siblings int"
ALONE, LEFT, RIGHT = 0, 1, 2  # the node has no sibling; its sibling stands left of it; right of it


def parent_digest(*children: bytes) -> bytes:
    """sha256 of the children's digests as hex text, one after the other."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def _sized(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(n_chars: Column) -> Column:
    """sha256 of doc_id, source, lang, n_chars and text, each as its UTF-8 byte count, a colon and itself, or "-" if null."""
    parts = [_sized(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def tampered() -> Column:
    """Rows whose unsigned crc32 of the decimal doc_id is a multiple of seven; never those without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with index, their place among the rows of their tree from 0 on, and n, the rows of the tree. Rows are dealt by
    range and sorted, then each partition's share of a tree is counted; offsets have one row for each tree and partition
    that holds some of it, so no tree passes through one task whole. rows must be a stored table."""
    dealt = stored(
        rows.withColumn("_row", F.monotonically_increasing_id())  # equal rows are dealt to more than one partition
        .repartitionByRange(tree, *order, "_row").sortWithinPartitions(tree, *order, "_row")
        .withColumn("_at", F.monotonically_increasing_id()).drop("_row"),
        "ranked",
    ).withColumn("_part", F.shiftright("_at", 33))
    shares = dealt.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    own = Window.partitionBy(tree)
    earlier = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = shares.select(tree, "_part", (earlier - F.col("_first")).alias("_offset"), F.sum("_n").over(own).alias("n"))
    return dealt.join(offsets, [tree, "_part"]).withColumn("index", F.col("_at") + F.col("_offset")).drop("_at", "_part", "_offset")


def climb(digests: list[bytes], height: int) -> list[list[bytes]]:
    """Digests of all levels of a block, from the given lowest one up. The heap is ordered by the label of the receiver,
    then by the place of the sender, so a node's messages come off it together and in order."""
    queue: list[tuple[int, int, int, bytes]] = []
    levels = [digests] + [[] for _ in range(height)]
    if height:
        for i, d in enumerate(digests):
            heappush(queue, (1, i >> 1, i, d))
    while queue:
        level, index, _, first = heappop(queue)
        children = [first]
        while queue and queue[0][:2] == (level, index):
            children.append(heappop(queue)[3])
        own = parent_digest(*children)
        levels[level].append(own)
        if level < height:
            heappush(queue, (level + 1, index >> 1, index, own))
    return levels


def descend(levels: list[list[bytes]], above: bytes) -> list[bytes]:
    """Proofs of the lowest level's nodes, given the one of the block's top. Labels are swept in descending order."""
    queue: list[tuple[int, int, bytes]] = [(-(len(levels) - 1), 0, above)]
    proofs: list[bytes] = [b""] * len(levels[0])
    while queue:
        level, index, proof = heappop(queue)
        if level == 0:
            proofs[index] = proof
            continue
        row = levels[-level - 1]
        children = row[2 * index : 2 * index + 2]
        if len(children) == 1:
            heappush(queue, (level + 1, 2 * index, bytes([ALONE]) + proof))
        else:
            heappush(queue, (level + 1, 2 * index, bytes([RIGHT]) + children[1] + proof))
            heappush(queue, (level + 1, 2 * index + 1, bytes([LEFT]) + children[0] + proof))
    return proofs


def proof_steps(proof: bytes) -> Iterator[tuple[int, bytes]]:
    """Side and sibling of each level, from the leaf up."""
    at = 0
    while at < len(proof):
        side = proof[at]
        yield side, proof[at + 1 : at + 33] if side else b""
        at += 33 if side else 1


def fold(leaf: bytes, proof: bytes) -> bytes:
    """The root that a leaf and its siblings give."""
    for side, sibling in proof_steps(proof):
        leaf = parent_digest(leaf) if side == ALONE else parent_digest(sibling, leaf) if side == LEFT else parent_digest(leaf, sibling)
    return leaf


def _height(n: int, span: int) -> int:
    """Levels above the lowest one of a block, n nodes being in that level of its whole tree."""
    return span if n > 1 << span else (n - 1).bit_length()


def _packed(span: int):
    def rows(table: pa.Table) -> pa.Table:
        """One row for a block: its digests packed, and the digest of its top."""
        rows = sorted(table.to_pylist(), key=lambda r: r["at"])
        digests = [r["digest"] for r in rows]
        first = rows[0]
        out = {
            "tree": first["tree"], "block": first["block"], "n": first["n"], "top": climb(digests, _height(first["n"], span))[-1][0],
            "digests": b"".join(digests), "names": [r["name"] for r in rows], "doc_ids": [r["doc_id"] for r in rows],
            "altered": [r["altered"] for r in rows],
        }
        return pa.Table.from_pylist([out], _schema(BLOCKS))

    return rows


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = []
    for name, kind in (f.rsplit(" ", 1) for f in ddl.split(", ")):
        inner = kind[6:-1] if kind.startswith("array<") else None
        fields.append((name, pa.list_(kinds[inner]) if inner else kinds[kind]))
    return pa.schema(fields)


def blocks_of(nodes: DataFrame, span: int) -> DataFrame:
    """Blocks of one round. nodes: tree, index, n (nodes of the tree in this round), digest, name, doc_id, altered."""
    cut = nodes.withColumn("block", F.shiftright("index", span)).withColumn("at", (F.col("index") % (1 << span)).cast("int"))
    cut = cut.select("tree", "block", "at", "n", "digest", "name", "doc_id", "altered")
    return stored(cut.groupBy("tree", "block").applyInArrow(_packed(span), BLOCKS), "blocks")


def _rounds(nodes: DataFrame, most: int, span: int) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of all rounds of a forest, lowest first, and the roots (tree, digest). most: nodes of the largest tree."""
    size, rounds, ended = 1 << span, [], None
    while True:
        rounds.append(blocks_of(nodes, span))
        ends = rounds[-1].filter(F.col("n") <= size).select("tree", F.col("top").alias("digest"))
        ended = ended.unionByName(ends) if ended else ends
        if most <= size:
            return rounds, ended
        most = -(-most // size)
        nodes = rounds[-1].filter(F.col("n") > size).select(
            "tree", F.col("block").alias("index"), F.ceil(F.col("n") / size).cast("long").alias("n"), F.col("top").alias("digest"),
            F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("altered"),
        )


def _hand_down(span: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The reversed sweep of blocks that know their top's proof: one message for each node of the lowest level."""
        schema = _schema(BELOW)
        for batch in batches:
            for i in range(batch.num_rows):  # one block at a time
                r = batch.slice(i, 1).to_pylist()[0]
                digests = [r["digests"][k : k + 32] for k in range(0, len(r["digests"]), 32)]
                proofs = descend(climb(digests, _height(r["n"], span)), r["steps"])
                first = r["block"] << span
                out = [
                    (r["tree"], first + k, name, proof, r["path"], doc, digest, altered)
                    for k, (name, proof, doc, digest, altered) in enumerate(zip(r["names"], proofs, r["doc_ids"], digests, r["altered"]))
                ]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return rows


def _reversed(rounds: list[DataFrame], tops: DataFrame, span: int) -> DataFrame:
    """What reaches the lowest nodes of a forest. tops: tree, steps, path of each root. A tree's root is the top of its only
    block in the round in which it has one."""
    messages = None
    for blocks in reversed(rounds):
        ready = blocks.filter(F.col("n") <= 1 << span).join(tops, "tree")
        if messages is not None:
            ready = ready.unionByName(blocks.filter(F.col("n") > 1 << span).join(messages, ["tree", "block"]))
        below = ready.select("tree", "block", "n", "digests", "names", "doc_ids", "altered", "steps", "path").mapInArrow(_hand_down(span), BELOW)
        messages = below if blocks is rounds[0] else stored(below.select("tree", "block", "steps", "path"), "proofs")
    return messages


def _leaf_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _schema(LEAVES)
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            root, subroot = r["path"]
            siblings = [s.hex() for side, s in proof_steps(r["steps"]) if side]
            folded = fold(r["altered"] or r["leaf"], r["steps"])
            proof = hashlib.sha256("".join(siblings).encode()).hexdigest()
            out.append((r["doc_id"], r["leaf"].hex(), subroot.hex(), root.hex(), proof, folded.hex(), folded == root, len(siblings)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)


def manifest(docs: DataFrame, altered: Column | None = None, span: int = SPAN) -> DataFrame:
    """Per row of docs its leaf, the root of its lang, the root of all, the digest of its proof, and whether its row still
    folds to the root where ``altered`` (a condition, none by default) holds: there n_chars is one more.

    docs has doc_id, source, lang, n_chars and text; other columns, whatever their names, don't count. Leaves of a lang
    ascend by doc_id, rows without one first, rows with equal ids by their digests. Null in any column is the digest's "-", so an
    empty text is another leaf than none. A row that repeats is a leaf of its own. A null lang is the first tree. An empty
    table gives no row. A document alone in its lang is that lang's root. span: blocks have 2^span nodes.
    """
    spark = docs.sparkSession
    n_chars = F.col("n_chars").cast("long")
    changed = F.lit(None).cast("binary")
    if altered is not None:
        changed = F.when(altered, leaf_digest(F.try_add(n_chars, F.lit(1))))
    leaves = stored(
        docs.select(
            F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-")).alias("tree"),  # "-" sorts before "="
            F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(n_chars).alias("digest"), changed.alias("altered"),
        ),
        "leaves",
    )
    if leaves.isEmpty():
        return spark.createDataFrame([], LEAVES)
    placed = ranked(leaves, "tree", ["doc_id", "digest"])
    most = leaves.groupBy("tree").count().agg(F.max("count")).first()[0]
    lower, subroots = _rounds(placed.withColumn("name", F.lit(None).cast("string")), most, span)

    subroots = stored(subroots.withColumnRenamed("tree", "name"), "subroots")
    n_trees = subroots.count()
    named = ranked(subroots.withColumn("tree", F.lit("")), "tree", ["name"])
    named = named.withColumns({"doc_id": F.lit(None).cast("long"), "altered": F.lit(None).cast("binary")})
    upper, roots = _rounds(named, n_trees, span)

    tops = roots.select("tree", F.lit(b"").alias("steps"), F.array("digest").alias("path"))
    found = _reversed(upper, tops, span)
    tops = stored(found.select(F.col("name").alias("tree"), "steps", F.concat("path", F.array("leaf")).alias("path")), "tops")
    return _reversed(lower, tops, span).mapInArrow(_leaf_rows, LEAVES)
