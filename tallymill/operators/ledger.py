"""Insert parsed messages into the ledger: accounts, balances, duplicates, pairing, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.operators.accounts import latest_balances, resolve_accounts
from tallymill.operators.dedup import is_definitional_transfer
from tallymill.operators.skew import attach, cut_lineage
from tallymill.operators.transfers import GROUP, pair_transfers
from tallymill.schemas import LEDGER


def ledger_rows(parsed: DataFrame) -> DataFrame:
    """Parsed rows with ``account_id`` in stored form, before duplicate search and pairing.

    The id is a function of user and message, so a repeated run gives the same ids. ``created_at`` is the insert order.
    """
    fixed = {
        "id": F.sha2(F.concat_ws("|", "user_id", "raw_sms_id"), 256),
        "status": F.when(F.col("account_number_masked").isNull(), "pending_review").otherwise(F.col("status")),
        "is_deleted": F.lit(False),
        "added_late": F.lit(False),
        "is_contra": is_definitional_transfer(F.col("matched_rule")),
        "created_at": F.col("created_at"),
    }
    known = {*parsed.columns}
    columns = []
    for field in LEDGER.fields:
        value = fixed.get(field.name, F.col(field.name) if field.name in known else F.lit(None))
        columns.append(value.cast(field.dataType).alias(field.name))
    return parsed.select(*columns)


def _age() -> Column:
    return F.unix_micros(F.col("message_time").cast("timestamp"))


def insert_starts(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row for each user of the new rows: the newest message, where in the insert order it goes, and the number of rows."""
    newest = rows.groupBy("user_id").agg(F.max(_age()).alias("_newest"), F.count("*").alias("_rows"))
    last = ledger.groupBy("user_id").agg(F.max(F.unix_micros("created_at")).alias("_last"))
    start = F.greatest("_newest", F.col("_last") + 1_000_000)
    return newest.join(last, "user_id", "left").select("user_id", "_newest", start.alias("_start"), "_rows")


def placed_in_order(rows: DataFrame) -> DataFrame:
    """``created_at`` of rows that carry the columns of ``insert_starts``: each millisecond of a message's age below the newest
    is a microsecond later."""
    at = F.timestamp_micros(F.col("_start") + F.floor((F.col("_newest") - _age()) / 1000).cast("long"))
    return rows.withColumn("created_at", at).drop("_newest", "_start", "_rows")


def insert_order(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """New rows with ``created_at``: an ingest reads a user's messages from the newest back, and its rows come after all
    that are stored for the user."""
    return placed_in_order(attach(rows, insert_starts(rows, ledger), ["user_id"], "raw_sms_id", "_rows"))


def storable(transactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be stored, and the others with what they lack."""
    lack = F.concat_ws(
        ",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in ("raw_sms_id", "user_id", "txn_date")]
    )
    marked = transactions.withColumn("error", F.nullif(lack, F.lit("")))
    return marked.filter("error IS NULL").drop("error"), marked.filter("error IS NOT NULL").select("raw_sms_id", "user_id", "error")


def update_ledger(
    transactions: DataFrame,
    balance_updates: DataFrame,
    ledger: DataFrame,
    accounts: DataFrame,
    known_ids: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(ledger, accounts, summary)`` after inserting the new rows.

    Every parsed row becomes one row; look-alikes are flagged, never dropped. ``known_ids`` (ids of stored
    rows) turns on idempotency: messages already stored are left out, which a re-read of an overlapping
    window would otherwise insert and flag again.
    """
    good, bad = storable(transactions)
    dimension, rows = resolve_accounts(good, accounts, balance_updates, insert_starts(good, ledger))
    dimension = latest_balances(balance_updates, dimension)
    new = ledger_rows(placed_in_order(rows))
    if known_ids is not None:
        new = new.join(known_ids, "id", "left_anti")
    arrived = ledger.withColumn("_arrived", F.lit(False)).unionByName(new.withColumn("_arrived", F.lit(True)))
    # the pairing reads a few columns of it several times, and all of them once
    updated = pair_transfers(cut_lineage(arrived), F.col("_arrived"))
    inserted = updated.filter("_arrived").select(
        F.lit("row").alias("what"), F.col("possible_duplicate_of").isNotNull().alias("flagged")
    )
    noticed = balance_updates.select(F.lit("balance").alias("what"), F.lit(False).alias("flagged"))
    failed = bad.select(F.lit("error").alias("what"), F.lit(False).alias("flagged"))
    summary = inserted.unionByName(noticed).unionByName(failed).agg(
        F.count_if(F.col("what") == "row").alias("transactions_inserted"),
        F.count_if(F.col("what") == "balance").alias("balances_updated"),
        F.lit(0).cast("bigint").alias("duplicates_skipped"),
        F.count_if("flagged").alias("duplicates_flagged"),
        F.count_if(F.col("what") == "error").alias("errors"),
    )
    return updated.drop("_arrived"), dimension, summary


def affected_rows(ledger: DataFrame, new_rows: DataFrame) -> DataFrame:
    """All stored rows that an insert can change: those of a user and magnitude that occur among the new rows, and
    infrastructure rows of a reference that occurs there, whatever their amount."""
    touched = new_rows.filter("amount IS NOT NULL").select("user_id", F.abs("amount").alias("magnitude")).distinct()
    same_amount = ledger.withColumn("magnitude", F.abs("amount")).join(touched, GROUP, "left_semi").select(*ledger.columns)
    references = new_rows.filter("ref_number IS NOT NULL").select("user_id", "ref_number").distinct()
    infra = ledger.filter("is_infrastructure").join(references, ["user_id", "ref_number"], "left_semi").select(*ledger.columns)
    return same_amount.unionByName(infra.join(same_amount.select("id"), "id", "left_anti"))
