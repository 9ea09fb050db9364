"""Repeated messages (dropped with a reason) and likely duplicate rows (flagged, never dropped)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions.text import BLANKS
from tallymill.operators.skew import HOT_ROWS, attach, hot_groups, over_groups

# Trust in a rule when two messages report the same amount, date and account.
SPECIFIC_PRIORITY = 3
RULE_PRIORITY = {"GENERIC_CREDIT": 1, "GENERIC_DEBIT": 0}
UNKNOWN_PRIORITY = -1
DEFINITIONAL_TRANSFERS = [
    "GENERIC_CC_PAYMENT", "PLUXEE_CREDIT", "NCMC_LOAD", "GENERIC_PPF_SSY", "CASH_DEPOSIT", "WALLET_LOAD",
]
SAME_REFERENCE, SAME_VALUES = 0.95, 0.6
ACTIVE = ["pending_review", "approved"]
DUPLICATE_KEYS = ["user_id", "account_id", "txn_date", "amount"]


def default_priority() -> dict[str, int]:
    """Every named rule above the two catch-alls."""
    from tallymill.operators.rules import RULES

    named = {r.id: SPECIFIC_PRIORITY for r in RULES if not r.discard}
    return {**named, **RULE_PRIORITY}


def repeat_key() -> Column:
    """Payment reference if there is one, else the digest of the trimmed text."""
    digest = F.concat(F.lit("body:"), F.md5(F.btrim("body", F.lit(BLANKS))))
    return F.when(F.col("ref_type") == "upi_rrn", F.concat(F.lit("ref:"), F.col("ref_number"))).otherwise(digest)


def compact_key() -> Column:
    """``repeat_key`` in bytes, for exchanges; null where that is null."""
    digest = F.concat(F.lit(b"b"), F.unhex(F.md5(F.btrim("body", F.lit(BLANKS)))))
    return F.when(F.col("ref_type") == "upi_rrn", F.encode(F.concat(F.lit("r"), F.col("ref_number")), "utf-8")).otherwise(digest)


def dedup_messages(matched: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """``(kept, log)`` of ``judge_messages``; ``log`` carries ``reason``."""
    judged = judge_messages(matched, **options)
    kept = judged.filter("kept").select(*matched.columns)
    return kept, judged.filter("reason IS NOT NULL").select(*matched.columns, "reason")


def judge_messages(
    matched: DataFrame,
    priority: dict[str, int] | None = None,
    order: list[str] | None = None,
    scope: list[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Matched rows with ``kept`` and the logged ``reason``. The rows carry ``id, user_id, body, rule_id,
    amount, txn_date, account_number_masked, ref_number, ref_type`` and the ``order`` columns. Nothing is compared across
    ``scope``, one user by default; ids are unique in a scope only. Rows of a scope with equal ``order`` columns arrive as one.

    First the repeats of a reference or text go (first kept). Then, among rows with equal amount, date and
    account, the highest rule priority stays, the earliest on ties. The log names the arriving message: a
    row that replaced the holder is logged although it stays, the replaced holder is not.
    """
    order = order or ["date", "id"]
    scope = ["user_id"] if scope is None else scope
    priority = default_priority() if priority is None else priority
    ranks = F.create_map(*[F.lit(x) for pair in priority.items() for x in pair])
    # the order columns travel once, inside _arrival
    rows = matched.select(
        *[c for c in matched.columns if c not in order or c in scope],
        F.struct(*order).alias("_arrival"),
        compact_key().alias("_key"),
        F.coalesce(F.try_element_at(ranks, F.col("rule_id")), F.lit(UNKNOWN_PRIORITY)).alias("_priority"),
    )
    key = [*scope, "_key"]
    firsts = over_groups(rows, key, "_arrival", {"_first_at": F.min("_arrival")}, hot_groups(rows, key, scope, hot_rows))
    marked = firsts.withColumn("_first", F.col("_first_at") == F.col("_arrival")).drop("_first_at", "_key")
    repeat = F.when(~F.col("_first"), F.when(F.col("ref_type") == "upi_rrn", "duplicate_rrn").otherwise("duplicate_body"))
    same = [*scope, *[c for c in ("amount", "txn_date", "account_number_masked") if c not in scope]]
    # rows without values, and repeats, are compared with nothing: each is a group of its own
    known = F.col("account_number_masked").isNotNull() & F.col("amount").isNotNull()
    complete = F.col("_first") & known
    apart = marked.withColumn("_apart", F.when(~complete, F.xxhash64("_arrival")))
    hot = hot_groups(rows.filter(known).withColumn("_apart", F.lit(None).cast("long")), [*same, "_apart"], scope, hot_rows)
    # The holder's priority when a row arrives is the running maximum before it. Priorities are few, so
    # the first arrival at each priority is all that has to be known per group.
    levels = sorted({*priority.values(), UNKNOWN_PRIORITY})
    at = {f"_at_{i}": F.min(F.when(F.col("_priority") == p, F.col("_arrival"))) for i, p in enumerate(levels)}
    judged = over_groups(apart, [*same, "_apart"], "_arrival", at, hot)
    before = [F.when(F.col(f"_at_{i}") < F.col("_arrival"), F.lit(p)) for i, p in enumerate(levels)]
    survivor = F.coalesce(*[F.col(f"_at_{i}") for i in reversed(range(len(levels)))])
    holder = F.greatest(*before)
    logged = F.when(
        complete & holder.isNotNull(),
        F.when(F.col("_priority") > holder, "contra_replaced_existing").otherwise("contra_lower_priority"),
    )
    lost = F.coalesce(complete & (survivor != F.col("_arrival")), F.lit(False))
    return judged.select(
        *[F.col(f"_arrival.{c}") if c in order else F.col(c) for c in matched.columns],
        (repeat.isNull() & ~lost).alias("kept"),
        F.coalesce(repeat, logged).alias("reason"),
    )


def is_definitional_transfer(rule: Column) -> Column:
    return F.coalesce(rule.isin(DEFINITIONAL_TRANSFERS), F.lit(False))


def flag_duplicates(ledger: DataFrame) -> DataFrame:
    """Add ``possible_duplicate_of`` and ``duplicate_confidence``; flagged active rows go to review.

    The candidate is the oldest earlier row of the same user, account, day and amount that is neither
    deleted nor a transfer: active rows first, reviewed rows when there is no active one. Only the oldest
    row of each pool can ever be a candidate, so one partial aggregate per key replaces a self join.
    """
    me = F.struct("created_at", "id")
    entry = F.struct("created_at", "id", "ref_number")
    usable = ~F.col("is_deleted") & ~F.col("is_contra") & F.col("amount").isNotNull()
    active, reviewed = F.col("status").isin(ACTIVE), F.col("status") == "user_reviewed"
    oldest = (
        ledger.filter(usable)
        .groupBy(*DUPLICATE_KEYS)
        .agg(
            F.count("*").alias("_n"),
            F.min(F.when(active, entry)).alias("_active"),
            F.min(F.when(reviewed, entry)).alias("_reviewed"),
        )
        .filter("_n > 1")
    )
    joined = attach(ledger, oldest, DUPLICATE_KEYS, "id")

    def earlier(pool: str) -> Column:
        return F.when(F.struct(f"{pool}.created_at", f"{pool}.id") < me, F.col(pool))

    found = F.when(~F.col("is_contra") & ~F.col("is_deleted"), F.coalesce(earlier("_active"), earlier("_reviewed")))
    flagged = joined.withColumn("_candidate", found)
    hit = F.col("_candidate").isNotNull()
    return flagged.select(
        *[c for c in ledger.columns if c not in ("status", "possible_duplicate_of", "duplicate_confidence")],
        F.when(hit & active, "pending_review").otherwise(F.col("status")).alias("status"),
        F.col("_candidate.id").alias("possible_duplicate_of"),
        F.when(hit, F.when(F.col("ref_number") == F.col("_candidate.ref_number"), SAME_REFERENCE).otherwise(SAME_VALUES))
        .cast("double")
        .alias("duplicate_confidence"),
    )


def last_per_id(changes: DataFrame, key: str = "id") -> DataFrame:
    """One change for each row: the last by ``changed_at`` if there is such a column, ties and all others by content."""
    order = [F.col("changed_at")] if "changed_at" in changes.columns else []
    row = F.struct(*changes.columns)
    last = changes.groupBy(key).agg(F.max_by(row, F.struct(*order, F.to_json(row))).alias("_last"))
    return last.select("_last.*")


def apply_duplicate_decisions(ledger: DataFrame, decisions: DataFrame) -> DataFrame:
    """``decisions(id, decision)``: ``confirm`` soft-deletes the row, ``dismiss`` clears the flag and approves. Of several
    decisions on a row the last counts."""
    joined = ledger.join(last_per_id(decisions), "id", "left")
    confirm = F.coalesce(F.col("decision") == "confirm", F.lit(False))
    dismiss = F.coalesce(F.col("decision") == "dismiss", F.lit(False))
    changed = {
        "is_deleted": F.col("is_deleted") | confirm,
        "possible_duplicate_of": F.when(~dismiss, F.col("possible_duplicate_of")),
        "duplicate_confidence": F.when(~dismiss, F.col("duplicate_confidence")),
        "status": F.when(dismiss, "approved").otherwise(F.col("status")),
    }
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in ledger.columns])
