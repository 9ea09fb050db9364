"""Messages no rule explains, and the model answers that come back for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions import extract as X
from tallymill.functions.text import BLANKS
from tallymill.operators.parse import signed
from tallymill.operators.skew import cut_lineage
from tallymill.schemas import MODEL_ANSWER, REVIEW_FLOOR


def escalations(staged: DataFrame) -> DataFrame:
    """Queue of messages that passed the filter without a rule match."""
    return staged.filter("outcome = 'none'").select(
        "id", "user_id", "address", "date", "body", F.lit("no_layer2_rule").alias("reason"), "parse_failure", "amount"
    )


def candidate_report(staged: DataFrame) -> DataFrame:
    """Body with the failure and amount the device-side parse had given it."""
    return escalations(staged).select(
        "id", "body", F.col("parse_failure").alias("original_parse_failure"), F.col("amount").alias("original_amount")
    )


def parse_answer(text: Column) -> Column:
    """Model answer text to its fields; code fences are stripped. Any JSON object is an answer, and each field of it is read by
    itself: a number in quotes is a number, and a field that cannot be read is null without harm to the others. Text that is
    no object gives null."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    bare = F.regexp_replace(F.regexp_replace(trimmed, r"(?i)^```(?:json)?\s*", ""), r"\s*```\z", "")
    clean = F.btrim(F.when(trimmed.contains("```"), bare).otherwise(trimmed), F.lit(BLANKS))
    # arrays of one bind the clean text and the variant, which would else be made again for every field
    parsed = F.transform(F.array(clean), lambda c: F.when(c.startswith("{"), F.try_parse_json(c)))

    def fields(p: Column) -> Column:
        return F.struct(*[F.try_variant_get(p, f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in MODEL_ANSWER.fields])

    return F.get(F.transform(parsed, lambda p: F.when(p.isNotNull(), fields(p))), F.lit(0))


def last_answers(answers: DataFrame) -> DataFrame:
    """``(user_id, id, answer)``: one for each message of a user, the last by ``answered_at`` if there is such a column, ties and
    all others by text."""
    order = [F.col("answered_at")] if "answered_at" in answers.columns else []
    last = answers.groupBy("user_id", "id").agg(F.max_by(F.struct("text"), F.struct(*order, "text")).alias("_last"))
    return last.select("user_id", "id", parse_answer(F.col("_last.text")).alias("answer"))


def merge_answers(queue: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, discards, failures)``: ledger-shaped rows of real answers, the messages called promotional, and the messages of
    the queue whose answer is missing, is no object, or lacks amount or direction, with which of these it is.

    ``answers(user_id, id, text)``, with ``answered_at`` if several can come for a message: the last counts. Ids are those of a
    device, so users share them, and an answer belongs to one user's message. The queue with its answers is stored once; all three
    are read from it."""
    found = last_answers(answers).select(F.col("user_id").alias("_user"), F.col("id").alias("_id"), "answer", F.lit(True).alias("_answered"))
    met = queue.join(found, F.col("user_id").eqNullSafe(F.col("_user")) & (F.col("id") == F.col("_id")), "left")
    joined = cut_lineage(met.select("id", "user_id", "body", "date", "answer", "_answered"))
    promotional = F.coalesce(F.col("answer.is_promotional"), F.lit(False))
    discards = joined.filter(promotional).select("user_id", "id", F.lit("promotional").alias("reason"))
    failure = (
        F.when(F.col("_answered").isNull(), "no_answer")
        .when(F.col("answer").isNull(), "broken")
        .when(~promotional & (F.col("answer.amount").isNull() | F.col("answer.direction").isNull()), "incomplete")
    )
    failures = joined.select("user_id", "id", failure.alias("reason")).filter("reason IS NOT NULL")
    real = joined.filter(~promotional & F.col("answer.amount").isNotNull() & F.col("answer.direction").isNotNull())
    day = F.to_date(F.timestamp_millis("date"))
    fields = real.select("id", "user_id", "body", day.alias("_day"), "answer.*").withColumn(
        "amount", F.round("amount", 2).cast("decimal(38,2)")
    )
    review = (
        F.col("account_number_masked").isNull()
        | (F.abs("amount") >= REVIEW_FLOOR)
        | F.coalesce("requires_classification", F.lit(False))
    )
    rows = fields.select(
        F.col("id").alias("raw_sms_id"),
        "user_id",
        F.coalesce(F.col("txn_date").try_cast("date"), "_day").alias("txn_date"),
        F.expr(signed("amount", "direction")).alias("amount"),
        "type",
        "category",
        "sub_category",
        "merchant",
        F.expr(X.merchant_key("merchant")).alias("merchant_key"),
        F.lit("haiku").alias("source"),
        F.when(review, "pending_review").otherwise("approved").alias("status"),
        "account_number_masked",
        "bank",
        "ref_number",
        "ref_type",
        "confidence",
        F.coalesce("requires_classification", F.lit(False)).alias("requires_classification"),
        F.coalesce("possible_contra", F.lit(False)).alias("possible_contra"),
        F.col("body").alias("raw_text"),
    )
    return rows, discards, failures
