"""Documents to training sequences: language, near duplicates, repeated passages, source weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
documents. run() writes the rows of each stage as Parquet into the shared folder and reads them for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm import binary_packing, curriculum, language_spans, simhash_bk, suffix_blocks
from tallymill.llm.common import stored
from tallymill.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose text has no letter, or letters that fit no language that the model learned; texts in several
    languages stay. The model learns from two of three documents that have a lang."""
    model = language_spans.train(docs.filter(language_spans.remainder(3) != 1))
    return language_spans.keep_known(docs.select(COLUMNS), model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id. Near are texts
    whose counts of five-word shingles have a cosine of 0.8; fingerprints within 24 of 64 bits are candidates."""
    return simhash_bk.keep_one(docs.select(COLUMNS), width=5, radius=24, anchors=16, cosine=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a document with a smaller doc_id has leave the texts, whole characters at a time. A text
    of which nothing is left goes, unless it was empty before."""
    found = suffix_blocks.repeated_bytes(docs.select("doc_id", "text"), length=50, whole_characters=True)
    cut = found.filter(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("kept").cast("string").alias("_kept"), F.size("spans").alias("_n"))
    # rows that repeat id and text get equal answers
    cut = cut.dropDuplicates(["_id", "_digest"])
    joined = docs.select(COLUMNS).join(cut, (F.col("doc_id") == F.col("_id")) & (F.unhex(F.md5("text")) == F.col("_digest")), "left")
    text = F.when(F.col("_n") > 0, F.col("_kept")).otherwise(F.col("text"))
    return (
        joined.withColumn("text", text)
        .filter("_n is null or length(trim(text)) > 0")
        .withColumn("n_chars", F.when(F.col("_n") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
        .select(COLUMNS)
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each time the mix takes a document, in order of training positions. A document in which a source's target
    ends is taken whole if at least half of it lies before the end, else not at all. Documents that it does not take go."""
    keyed = docs.select(COLUMNS).withColumn("_key", F.xxhash64("doc_id", "text", "source"))
    mixed = curriculum.mix(keyed.select(F.col("_key").alias("doc_id"), "text", "source"))
    times = mixed.select(
        F.col("doc_id").alias("_key"),
        F.col("size").alias("_size"),
        F.inline(
            F.array(
                F.struct(F.col("taken_first").alias("_taken"), F.col("position").alias("_position")),
                F.struct(F.col("taken_again").alias("_taken"), F.col("position_again").alias("_position")),
            )
        ),
    ).filter("_taken > 0 and 2 * _taken >= _size")
    rows = keyed.dropDuplicates(["_key"]).join(times, "_key")
    return rows.repartitionByRange("_position", "_key").sortWithinPartitions("_position", "_key").select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their token ids."""
    return binary_packing.pack(binary_packing.pieces(docs, tokenizer_path()), exchange=False)


STAGES = [
    ("language_spans", known_language),
    ("simhash_bk", near_duplicates),
    ("suffix_blocks", repeated_passages),
    ("curriculum", mix_sources),
    ("binary_packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
