"""Counts of a ledger that are kept up by the changes of edits, pages and ingests, instead of being counted again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What review counts and feed totals tell apart. A user has as many cells as statuses and categories allow.
CELL = ["user_id", "status", "is_deleted", "category"]


def cell_counts(ledger: DataFrame) -> DataFrame:
    """Rows of each cell, n, by counting."""
    return ledger.groupBy(*CELL).agg(F.count("*").alias("n"))


def signed_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a change does to the cells: n is how many rows a cell gains, or loses where it is negative.

    ``before`` and ``after`` hold the rows that the change touched, as they were and as they are; rows that are in both alike cancel out, so
    more than those do no harm. Inserted rows are only in ``after``, removed ones only in ``before``. No join is needed."""
    lost = before.select(*CELL, F.lit(-1).alias("_sign"))
    gained = after.select(*CELL, F.lit(1).alias("_sign"))
    return lost.unionByName(gained).groupBy(*CELL).agg(F.sum("_sign").alias("n")).filter("n <> 0")


def apply_changes(counts: DataFrame, *changes: DataFrame) -> DataFrame:
    """Counts after any number of changes, whose order does not matter. Cells that are left without rows go."""
    rows = counts.select(*CELL, "n")
    for change in changes:
        rows = rows.unionByName(change.select(*CELL, "n"))
    return rows.groupBy(*CELL).agg(F.sum("n").alias("n")).filter("n <> 0")


def review_counts_of(counts: DataFrame) -> DataFrame:
    """Per user: rows that wait for review, whether there is any row (deleted ones count), and the sizes of both feed tabs."""
    live = ~F.col("is_deleted")

    def total(*statuses: str):
        return F.sum(F.when(live & F.col("status").isin(*statuses), F.col("n")).otherwise(0))

    sums = counts.groupBy("user_id").agg(
        total("pending_review").alias("needs_review"),
        F.sum("n").alias("_rows"),
        total("pending_review", "approved").alias("active_total"),
        total("user_reviewed").alias("history_total"),
    )
    return sums.filter("_rows > 0").withColumn("has_any", F.lit(True)).drop("_rows")
