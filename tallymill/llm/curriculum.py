"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.common import WORD, stored


@dataclass(frozen=True)
class Curriculum:
    """weights repeat over the sources in code point order, null last. slopes, between -1 and 1, repeat likewise: a
    source's share of the stream at time t in [0, 1] is proportional to 1 + slope * (2 t - 1)."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    slopes: tuple[float, ...] = (-0.6, 0.0, 0.6)
    total: float = 1.5
    most: float = 2.0
    rows_per_bucket: int = 500


def _cycle(values: tuple[float, ...], rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def targets(sizes: DataFrame, plan: Curriculum) -> DataFrame:
    """(source, source_size) to one row per source with target, slope and weight.

    Water filling in closed form: with sources ordered by cap / weight, those before the first source that stays
    below its cap stop there, and the others share what is left by weight. One row per source: a small table.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order)
    ranked = sizes.select(
        "source", "source_size", _cycle(plan.weights, rank).alias("weight"), _cycle(plan.slopes, rank).alias("slope")
    ).withColumn("cap", plan.most * F.col("source_size"))
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    level = (
        plan.total * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    open_ = F.when(F.col("weight") * F.col("_level") < F.col("cap"), F.col("_level"))
    return (
        ranked.withColumn("_level", level)
        .withColumn("_open", F.first(open_, ignorenulls=True).over(full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("target", F.least("cap", F.coalesce(F.col("weight") * F.col("_open"), F.col("cap"))))
        .drop("_level", "_open", "cap")
    )


def _when(taken_before: Column) -> Column:
    """Training time at which a source's cumulative demand reaches a number of words: the demand up to t is
    target * (t + slope * (t * t - t)), the integral of the schedule, inverted here."""
    share = F.least(taken_before / F.col("target"), F.lit(1.0))
    a = F.col("slope")
    root = F.sqrt((1 - a) * (1 - a) + 4 * a * share)
    return F.when(F.col("target") > 0, F.when(F.abs(a) < 1e-12, share).otherwise((root - (1 - a)) / (2 * a)))


def mix(docs: DataFrame, plan: Curriculum = Curriculum()) -> DataFrame:
    """Words that the mix takes of each document, and the training positions at which it takes them.

    Returns the columns doc_id, source, size, source_size, target, taken, taken_first, taken_again, position and
    position_again, one row per input row, range-sorted by position (rows that are not taken come last).
    The documents of a source lie on one line in the order of a hash of doc_id and text; the mix takes the first
    ``target`` words of that line laid out twice, so a source meets its target to the word, and no document gives more
    than twice its size. A null or empty text has size 0 and takes nothing; a null source is a source of its own.
    Rows with equal doc_id and text are split at equal places by their number in the line, so reruns agree. An empty
    table gives an empty result. Other columns of the input are left out.
    """
    text = F.col("text")
    rows = stored(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.col("doc_id"), text).alias("_h"),
        ),
        "sizes",
    )
    n_buckets = max(16, rows.count() // plan.rows_per_bucket)
    rows = rows.withColumn("_bucket", F.floor((F.shiftright("_h", 32) + 2**31) * n_buckets / 2**32).cast("long"))
    key = [F.struct(F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("_source"), "_bucket"]
    sums = stored(
        rows.groupBy(*key).agg(F.first("source").alias("source"), F.sum("size").alias("_words")), "bucket_sizes"
    )
    goal = targets(sums.groupBy("_source").agg(F.first("source").alias("source"), F.sum("_words").alias("source_size")).drop("_source"), plan)
    goal = goal.withColumn("_source", key[0]).drop("source")
    starts = sums.select(
        "_source",
        "_bucket",
        F.coalesce(
            F.sum("_words").over(Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_before"),
    ).join(goal, "_source")
    inside = Window.partitionBy("_source", "_bucket").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("_source", key[0])
        .join(starts, ["_source", "_bucket"])
        .withColumn("_start", F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    )

    def part(start: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - start)).cast("long")

    again = F.col("_start") + F.col("source_size")
    out = placed.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        part(F.col("_start")).alias("taken_first"),
        part(again).alias("taken_again"),
        _when(F.col("_start").cast("double")).alias("_p"),
        _when(again.cast("double")).alias("_q"),
        "_h",
    )
    return (
        out.select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            (F.col("taken_first") + F.col("taken_again")).alias("taken"),
            "taken_first",
            "taken_again",
            F.when(F.col("taken_first") > 0, F.col("_p")).alias("position"),
            F.when(F.col("taken_again") > 0, F.col("_q")).alias("position_again"),
            "_h",
        )
        .repartitionByRange(F.col("position").asc_nulls_last(), F.col("_h"))
        .sortWithinPartitions(F.col("position").asc_nulls_last(), "_h")
        .drop("_h")
    )
