"""Account dimension: look up, create what is missing, keep the newest balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.operators.skew import attach
from tallymill.schemas import ACCOUNTS, UNKNOWN_ACCOUNT

KEYS = ["user_id", "account_number_masked"]


def account_id(user_id: Column, number: Column) -> Column:
    """Repeatable id of an account key."""
    return F.sha2(F.concat_ws("|", user_id, number), 256)


def _new_accounts(seen: DataFrame) -> DataFrame:
    unknown = F.col("account_number_masked") == UNKNOWN_ACCOUNT
    fixed = {
        "id": account_id(F.col("user_id"), F.col("account_number_masked")),
        "account_type": F.when((F.col("channel") == "Credit Card") & ~unknown, "credit_card").otherwise("bank"),
        "institution_name": F.when(unknown, "Unknown").otherwise(F.col("bank")),
        "balance_latest": F.lit(None),
        "balance_updated_at": F.lit(None),
        "aa_linked": F.lit(False),
        "is_active": F.lit(True),
    }
    return seen.select(
        *[fixed.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in ACCOUNTS.fields]
    )


def resolve_accounts(
    parsed: DataFrame, accounts: DataFrame, balance_updates: DataFrame | None = None, users: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(accounts, rows)``: the dimension with missing accounts added, and the rows with ``account_id``.

    Rows without a number share one ``UNKNOWN`` account per user. A new account takes bank and type from
    its first message in reading order, which is newest first, and a balance notice can be that message. First-seen values come from a
    partial aggregate, so a busy account is reduced before it is shuffled. Ids of accounts created here
    are a function of the key; only accounts that were already stored need a lookup. Columns of ``users``, one row for each
    ``user_id``, come to the rows by the same lookup, so that the rows do not move a second time for them.
    """
    number = F.coalesce("account_number_masked", F.lit(UNKNOWN_ACCOUNT))
    # a reading goes from the newest message back
    first = ["_age", "raw_sms_id"]
    age = (-F.unix_micros(F.col("message_time").cast("timestamp"))).alias("_age")
    keyed = parsed.withColumn("_number", number)
    arrivals = keyed.select("user_id", F.col("_number").alias("account_number_masked"), "bank", "channel", age, "raw_sms_id")
    if balance_updates is not None:
        usable = balance_updates.filter("account_number_masked IS NOT NULL AND balance IS NOT NULL")
        arrivals = arrivals.unionByName(
            usable.select(*KEYS, "bank", F.lit(None).cast("string").alias("channel"), age, "raw_sms_id")
        )
    seen = arrivals.groupBy(*KEYS).agg(
        F.min_by(F.struct("bank", "channel"), F.struct(*first)).alias("_first"), F.count("*").alias("_n")
    )
    seen = seen.select(*KEYS, "_first.*", "_n")
    stored = accounts.groupBy(*KEYS).agg(F.min("id").alias("_stored_id"))
    sized = seen.select(*KEYS, "_n")
    known = sized.join(stored, KEYS) if users is None else sized.join(stored, KEYS, "left").join(users, "user_id", "left")
    created = _new_accounts(seen.join(stored, KEYS, "left_anti"))
    lookup = known.withColumnRenamed("account_number_masked", "_number")
    rows = attach(keyed, lookup, ["user_id", "_number"], "raw_sms_id")
    rows = rows.withColumn(
        "account_id", F.coalesce("_stored_id", account_id(F.col("user_id"), F.col("_number")))
    ).drop("_number", "_stored_id", "_n")
    return accounts.unionByName(created), rows


def latest_balances(balance_updates: DataFrame, accounts: DataFrame) -> DataFrame:
    """Accounts with the balance of the newest message day.

    Within a day the latest message counts. A stored balance of the same or a later day stays. Updates
    without a number or a balance are ignored.
    """
    newest = (
        balance_updates.filter("account_number_masked IS NOT NULL AND balance IS NOT NULL")
        .groupBy(*KEYS)
        .agg(
            F.max_by(
                F.struct(F.col("balance").alias("_balance"), F.col("message_date").alias("_day")),
                F.struct("message_date", "message_time", "raw_sms_id"),
            ).alias("_new")
        )
        .select(*KEYS, "_new.*")
    )
    fresh = F.col("_day").isNotNull() & (
        F.col("balance_updated_at").isNull() | (F.col("_day") > F.col("balance_updated_at"))
    )
    return (
        accounts.join(newest, KEYS, "left")
        .withColumn("balance_latest", F.when(fresh, F.col("_balance")).otherwise(F.col("balance_latest")))
        .withColumn("balance_updated_at", F.when(fresh, F.col("_day")).otherwise(F.col("balance_updated_at")))
        .select(*accounts.columns)
    )
