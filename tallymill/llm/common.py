"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, everywhere in this package.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.

    Where that is unset, a folder of this machine is used under a local master only; on a cluster it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, and it outlives executors."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text, none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def partitions_for(spark: SparkSession, n_bytes: int, each: int) -> int:
    """So many partitions that one holds about ``each`` bytes, and no core is idle."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // each))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node that each node reaches over undirected links (a, b), for all nodes that have a link.

    Alternates two steps until nothing changes: link every larger neighbour of a node to the smallest of its
    neighbourhood, then every smaller one. Both are a minimum with partial aggregation and a join, which adaptive
    execution splits where a node has very many neighbours. Every round is stored in the shared folder.
    Returns (node, component). Links of a node to itself are ignored; an empty table gives an empty one.
    """

    def step(edges: DataFrame, larger: bool) -> DataFrame:
        """edges have a > b. The neighbourhood is all neighbours for the first step, the smaller ones for the second."""
        if larger:
            near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            near = edges
        least = near.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("least"))
        joined = near.join(least, "a")
        if larger:
            moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        else:
            moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
                least.select("a", F.col("least").alias("b"))
            )
        return moved.filter("a > b").distinct()

    def mark(edges: DataFrame) -> tuple:
        row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return row.n, row.s

    edges = stored(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "links"
    )
    before = mark(edges)
    for _ in range(rounds if before[0] else 0):
        edges = stored(step(step(edges, True), False), "links")
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def union_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reached from each of n indexes over the given links."""
    root = np.arange(n)
    left, right = np.asarray(left, dtype=np.int64), np.asarray(right, dtype=np.int64)
    while len(left):
        a, b = root[left], root[right]
        open_ = a != b
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        if not len(left):
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root
