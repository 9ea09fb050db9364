"""Feed pages, review counts and display columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.schemas import REF_TYPES, SOURCES, STATUSES, TXN_TYPES

PAGE_SIZE = 20

# Stored category keys and their labels.
CATEGORY_LABELS = {
    "food_dining": "Food & Dining",
    "groceries": "Groceries",
    "transport": "Transport",
    "shopping": "Shopping",
    "bills_utilities": "Bills & Utilities",
    "entertainment": "Entertainment",
    "health": "Health",
    "travel": "Travel",
    "rent_housing": "Rent & Housing",
    "education": "Education",
    "investments": "Investments",
    "transfers": "Transfers",
    "income": "Income",
    "fees_charges": "Fees & Charges",
    "uncategorized": "Uncategorized",
}
FALLBACK_LABEL = "Uncategorized"
HISTORY_NOTE = "Possible internal transfer — matching transaction already reviewed"
TRANSFER_NOTE = "Possible internal transfer"


def feed_filter(
    ledger: DataFrame, tab: str = "active", status_filter: str = "all", category: str | None = None
) -> DataFrame:
    """Rows of a feed tab: history shows reviewed rows, the active tab the two open statuses or one of them."""
    if tab == "history":
        statuses = ["user_reviewed"]
    else:
        statuses = ["pending_review", "approved"] if status_filter == "all" else [status_filter]
    rows = ledger.filter(~F.col("is_deleted") & F.col("status").isin(statuses))
    return rows if category is None else rows.filter(F.col("category") == category)


def feed_page(
    ledger: DataFrame,
    user_id: str,
    tab: str = "active",
    status_filter: str = "all",
    category: str | None = None,
    page: int = 0,
    page_size: int = PAGE_SIZE,
) -> DataFrame:
    """One page, newest day first, ties by id; ``total_count`` is the size of the whole filtered feed."""
    rows = feed_filter(ledger, tab, status_filter, category).filter(F.col("user_id") == user_id)
    total = rows.groupBy("user_id").agg(F.count("*").alias("total_count"))  # one row: one user
    top = rows.orderBy(F.desc("txn_date"), "id").offset(page * page_size).limit(page_size)
    return top.join(total, "user_id").withColumn("page_count", page_count(page_size))


def page_count(page_size: int = PAGE_SIZE):
    return F.greatest(F.lit(1), F.ceil(F.col("total_count") / page_size)).cast("int")


def row_by_id(ledger: DataFrame, user_id: str, row_id: str) -> DataFrame:
    return ledger.filter((F.col("user_id") == user_id) & (F.col("id") == row_id))


def review_counts(ledger: DataFrame) -> DataFrame:
    """Per user: rows waiting for review, and whether there is any row at all (deleted ones count)."""
    waiting = (F.col("status") == "pending_review") & ~F.col("is_deleted")
    return ledger.groupBy("user_id").agg(
        F.count_if(waiting).alias("needs_review"), (F.count("*") > 0).alias("has_any")
    )


def category_labels(spark) -> DataFrame:
    return spark.createDataFrame(list(CATEGORY_LABELS.items()), "category string, category_label string")


def display_rows(rows: DataFrame) -> DataFrame:
    """Magnitude, direction from the sign, category label with fallback, badge and amount style."""
    labels = category_labels(rows.sparkSession)  # fifteen fixed rows
    asks = F.col("possible_contra_of").isNotNull() & ~F.col("is_contra")
    label = F.coalesce("category_label", F.lit(FALLBACK_LABEL))
    return rows.join(F.broadcast(labels), "category", "left").select(
        "id",
        "user_id",
        "txn_date",
        F.abs("amount").alias("magnitude"),
        F.when(F.col("amount") >= 0, "credit").otherwise("debit").alias("direction"),
        F.when(F.col("is_contra"), "Transfer").otherwise(label).alias("category_badge"),
        F.coalesce("merchant", label).alias("title"),
        F.when(F.col("status") == "pending_review", "Pending Review")
        .when(asks, "Confirm transfer?")
        .alias("status_badge"),
    )


def transfer_notes(ledger: DataFrame) -> DataFrame:
    """Open transfer questions with their partner; a partner that is gone leaves nothing to ask."""
    asks = ledger.filter(F.col("possible_contra_of").isNotNull() & ~F.col("is_contra"))
    partners = ledger.select(
        F.col("id").alias("partner_id"), F.col("status").alias("partner_status"), F.col("user_id").alias("_user")
    )
    matched = (F.col("possible_contra_of") == F.col("partner_id")) & (F.col("user_id") == F.col("_user"))
    note = F.when(F.col("partner_status") == "user_reviewed", HISTORY_NOTE).otherwise(TRANSFER_NOTE)
    return asks.join(partners, matched).select("id", "user_id", "partner_id", "partner_status", note.alias("note"))


def ledger_violations(ledger: DataFrame) -> DataFrame:
    """Counts of rows that break a declared type, enum or range."""
    def outside(column: str, allowed: list[str], nullable: bool):
        bad = F.col(column).isNotNull() & ~F.col(column).isin(allowed)
        return bad if nullable else bad | F.col(column).isNull()

    checks = {
        "status": outside("status", STATUSES, False),
        "type": outside("type", TXN_TYPES, True),
        "source": outside("source", SOURCES, False),
        "ref_type": outside("ref_type", REF_TYPES, True),
        "account_id": F.col("account_id").isNull(),
        "txn_date": F.col("txn_date").isNull(),
        "duplicate_confidence": F.col("duplicate_confidence").isNotNull() & ~F.col("duplicate_confidence").between(0, 1),
        "self_link": F.coalesce(F.col("possible_contra_of") == F.col("id"), F.lit(False))
        | F.coalesce(F.col("possible_duplicate_of") == F.col("id"), F.lit(False)),
    }
    present = {name: bad for name, bad in checks.items() if name in ledger.columns or name == "self_link"}
    counted = ledger.agg(*[F.count_if(bad).alias(name) for name, bad in present.items()])
    return counted.unpivot([], list(present), "rule", "violations")
