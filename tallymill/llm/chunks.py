"""Documents in chunks, and sets of keys that travel between chunks and key buckets as packed arrays.

A chunk is a group of documents of bounded size, dealt by a hash of doc_id. A task that holds a chunk sends the distinct
keys of the chunk to the keys' buckets, one array for each bucket; the task of a bucket finds the keys that repeat and
sends each chunk those of its own. So a key has one entry for each chunk, however often it occurs, and the texts move
once: the exchange that deals documents to chunks is the same in every step, and Spark reuses it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import stored

CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
#: Texts are hashed as one array of about so many bytes.
SLAB_BYTES = 1 << 18

MESSAGE = "chunk int, kind int, keys binary, more binary"


@dataclass
class Chunked:
    docs: DataFrame  # chunk, doc_id, digest, text
    first: DataFrame  # chunk, kind, keys, more: messages of kind 0, the digests whose first document is in the chunk
    n_chunks: int
    n_buckets: int


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> Chunked:
    """Equal texts are told by their MD5 digest. Of each group of equal texts one document is the first, that of the
    smallest doc_id; its message also says how many rows have the text."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")
    ).withColumn("digest", F.unhex(F.md5("text")))
    groups = stored(
        rows.groupBy("digest").agg(
            F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.max(F.octet_length("text")).alias("size")
        ),
        "texts",
    )
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    cores = docs.sparkSession.sparkContext.defaultParallelism
    n_chunks = max(1, -(-total // chunk_bytes), min(4 * cores, total // 65_536))
    chunk = F.pmod(F.xxhash64("doc_id"), F.lit(n_chunks)).cast("int").alias("chunk")
    first = groups.select(
        chunk,
        F.lit(0).alias("kind"),
        F.concat("digest", F.unhex(F.lpad(F.hex("n"), 16, "0"))).alias("keys"),
        F.lit(None).cast("binary").alias("more"),
    )
    return Chunked(rows.select(chunk, "doc_id", "digest", "text"), first, n_chunks, max(1, -(-total // bucket_bytes), min(cores, n_chunks)))


def per_chunk(docs: DataFrame, messages: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    return docs.groupBy("chunk").cogroup(messages.groupBy("chunk")).applyInArrow(work, schema)


def firsts(docs: pa.Table, messages: pa.Table) -> tuple[np.ndarray, dict[bytes, int]]:
    """Row numbers of the first documents of their texts, and how many rows have the text of each digest that is
    first here."""
    rows = {}
    for kind, keys in zip(messages["kind"].to_pylist(), messages["keys"].to_pylist()):
        if kind == 0:
            rows[keys[:16]] = int.from_bytes(keys[16:], "big")
    best: dict[bytes, int] = {}
    ids = docs["doc_id"].to_pylist()
    for i, d in enumerate(docs["digest"].to_pylist()):
        if d in rows and (d not in best or (ids[i] is not None and (ids[best[d]] is None or ids[i] < ids[best[d]]))):
            best[d] = i
    return np.array(sorted(best.values()), dtype=np.int64), rows


def slabs(texts: list[bytes], slab_bytes: int = SLAB_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts, about slab_bytes at a time, with the number of the first."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) + 1
        if held >= slab_bytes:
            yield at, texts[at : i + 1]
            at, held = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)


def short(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """What is told apart of a key: its bucket and its low 32 bits. Two keys may coincide; what follows checks."""
    return (bucket_of(keys, n_buckets).astype(np.uint64) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))


def table(schema: str, columns: dict[str, list]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    names = [x.split() for x in schema.split(", ")]
    return pa.table({n: pa.array(columns[n], type=kinds[k]) for n, k in names})
