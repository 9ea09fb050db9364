"""Counters over staged rows: funnel, histograms, breakdowns, filter quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions.text import any_of
from tallymill.operators.filters import is_known_noise, is_known_promo


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(part * F.lit(100.0), whole), 1), F.lit(0.0))


def _staged_counts() -> list[Column]:
    sender = F.col("drop_reason") == "sender"
    return [
        F.count("*").alias("total"),
        F.count_if(sender).alias("sender_dropped"),
        F.count_if(F.col("drop_reason").isNotNull() & ~sender).alias("body_dropped"),
        F.count_if(F.col("drop_reason").isNull()).alias("passed"),
        F.count_if(F.col("outcome") == "matched").alias("matched"),
        F.count_if(F.col("outcome") == "discard").alias("discarded"),
        F.count_if(F.col("outcome") == "none").alias("escalated"),
    ]


def funnel(staged: DataFrame, by: list[Column] | None = None) -> DataFrame:
    """Counts per layer with drop and match rates; the match rate is over what passed the filter."""
    return staged.groupBy(*(by or [])).agg(*_staged_counts()).withColumns(
        {
            "sender_drop_rate": _share(F.col("sender_dropped"), F.col("total")),
            "body_drop_rate": _share(F.col("body_dropped"), F.col("total")),
            "match_rate": _share(F.col("matched"), F.col("passed")),
        }
    )


def histogram(rows: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Counts by value, largest first, ties by value."""
    return rows.groupBy(column).agg(F.count("*").alias(name)).orderBy(F.desc(name), column)


def drop_reasons(staged: DataFrame) -> DataFrame:
    return histogram(staged.filter("drop_reason IS NOT NULL"), "drop_reason")


def rule_hits(staged: DataFrame) -> DataFrame:
    return histogram(staged.filter("outcome IN ('matched', 'discard')"), "rule_id")


def failure_breakdown(staged: DataFrame) -> DataFrame:
    return histogram(staged.filter("parse_failure IS NOT NULL"), "parse_failure")


def category_breakdown(staged: DataFrame) -> DataFrame:
    rows = staged.filter("stage IN ('matched', 'fallback', 'escalated', 'discard')")
    return histogram(rows.withColumn("category", F.coalesce("category", F.lit("unclassified"))), "category")


def parse_summary(staged: DataFrame) -> DataFrame:
    row = F.col("stage").isin("matched", "fallback", "escalated", "discard")
    return staged.agg(
        F.count_if(row).alias("total"),
        F.count_if(row & (F.col("status") == "approved")).alias("approved"),
        F.count_if(row & (F.col("status") == "pending_review")).alias("pending_review"),
        F.count_if(F.col("parse_failure").isNotNull()).alias("parse_failures"),
        F.count_if(F.col("stage") == "balance_update").alias("balance_updates"),
    )


def filter_verdicts(staged: DataFrame) -> DataFrame:
    """Ground-truth verdict per message: promotions and noise that passed, priced messages that did not."""
    low = "lower(body)"
    truth = staged.selectExpr(
        "*",
        f"{is_known_promo(low)} AS is_promo",
        f"{is_known_noise(low)} AS is_noise",
        f"{any_of(low, ['rs.', 'inr', 'debited', 'credited'])} AS could_be_real",
    )
    passed = F.col("drop_reason").isNull()
    known = F.col("is_promo") | F.col("is_noise")
    wrongly_passed = passed & known
    wrongly_dropped = ~passed & (F.col("drop_reason") != "sender") & ~known & F.col("could_be_real")
    verdict = (
        F.when(wrongly_passed & F.col("is_promo"), "passed_promo")
        .when(wrongly_passed, "passed_noise")
        .when(wrongly_dropped, "dropped_real")
        .otherwise("agreed")
    )
    return truth.withColumn("verdict", verdict)


def filter_quality(staged: DataFrame) -> DataFrame:
    return filter_verdicts(staged).groupBy("verdict").agg(F.count("*").alias("n"))


def all_reports(staged: DataFrame) -> DataFrame:
    """report, value and n of every report of this module, in one pass over the staged rows.

    Rows are counted by their verdicts first; there are as many such cells as rules, reasons and categories allow, however many rows
    there are, and each report is a sum over cells. Totals are there with n = 0 too; an empty table has no rows at all."""
    verdicts = ["drop_reason", "outcome", "stage", "rule_id", "parse_failure", "category", "status", "verdict"]
    cells = filter_verdicts(staged).groupBy(*verdicts).agg(F.count("*").alias("_n"))
    row = F.col("stage").isin("matched", "fallback", "escalated", "discard")
    sender, passed = F.col("drop_reason") == "sender", F.col("drop_reason").isNull()
    values = {
        "drop_reasons": F.col("drop_reason"),
        "rule_hits": F.when(F.col("outcome").isin("matched", "discard"), F.col("rule_id")),
        "failure_breakdown": F.col("parse_failure"),
        "category_breakdown": F.when(row, F.coalesce("category", F.lit("unclassified"))),
        "filter_quality": F.col("verdict"),
    }
    totals = {
        ("funnel", "total"): F.lit(True),
        ("funnel", "sender_dropped"): sender,
        ("funnel", "body_dropped"): ~passed & ~sender,
        ("funnel", "passed"): passed,
        ("funnel", "matched"): F.col("outcome") == "matched",
        ("funnel", "discarded"): F.col("outcome") == "discard",
        ("funnel", "escalated"): F.col("outcome") == "none",
        ("parse_summary", "total"): row,
        ("parse_summary", "approved"): row & (F.col("status") == "approved"),
        ("parse_summary", "pending_review"): row & (F.col("status") == "pending_review"),
        ("parse_summary", "parse_failures"): F.col("parse_failure").isNotNull(),
        ("parse_summary", "balance_updates"): F.col("stage") == "balance_update",
    }
    entries = [F.struct(F.lit(report).alias("report"), value.alias("value"), F.col("_n").alias("n")) for report, value in values.items()]
    entries += [
        F.struct(F.lit(report).alias("report"), F.lit(name).alias("value"), F.when(test, F.col("_n")).otherwise(0).alias("n"))
        for (report, name), test in totals.items()
    ]
    listed = cells.select(F.inline(F.array(*entries))).filter("value IS NOT NULL")
    return listed.groupBy("report", "value").agg(F.sum("n").alias("n"))


def samples(rows: DataFrame, order: list[str], n: int, snippet: int = 80) -> DataFrame:
    """First ``n`` rows of a report list in a stable order, with the text cut to a snippet."""
    return rows.orderBy(*order).limit(n).withColumn("snippet", F.substring("body", 1, snippet))


def model_outcomes(answers: DataFrame, escalated: DataFrame) -> DataFrame:
    """Parsed, promotional and missing answers of an escalation run."""
    got = answers.select(
        F.lit(0).alias("asked"),
        F.lit(1).alias("answered"),
        F.coalesce(F.col("answer.is_promotional"), F.lit(False)).cast("int").alias("promotional"),
    )
    asked = escalated.select(F.lit(1).alias("asked"), F.lit(0).alias("answered"), F.lit(0).alias("promotional"))
    return got.unionByName(asked).agg(
        F.sum("asked").alias("asked"),
        F.sum(F.col("answered") - F.col("promotional")).alias("parsed"),
        F.sum("promotional").alias("promotional"),
        F.sum(F.col("asked") - F.col("answered")).alias("errors"),
    )
