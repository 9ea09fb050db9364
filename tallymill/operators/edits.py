"""Change sets over a page of the ledger: edits, splits, submit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.operators.dedup import last_per_id
from tallymill.operators.skew import cut_lineage
from tallymill.operators.transfers import pair_transfers
from tallymill.schemas import REVIEW_FLOOR

# Sub-categories that bring money in, and the editor's options.
POSITIVE_SUB_CATEGORIES = ["Maturity", "Sell", "Redemption", "Sale"]
SPLIT_TOLERANCE = 0.005
EDITOR_OPTIONS = {
    "Expense": {
        "Food": [], "Travel": [], "Shopping": [], "Utilities": [], "Housing": ["Rent"], "Medical": [],
        "Entertainment": [], "Education": [], "Insurance Premium": [], "Other Expense": [],
    },
    "Income": {"Salary": [], "Consulting Fee": [], "Rental Income": [], "Business Income": []},
    "Investment": {
        "Mutual Fund": ["SIP", "Lumpsum", "Redemption"], "Equity": ["Buy", "Sell"], "Gold": ["Buy", "Sell"],
        "Fixed Deposit": ["New FD", "Maturity"], "EPF": ["Contribution"], "NPS": ["Contribution"],
        "PPF": ["Contribution"],
    },
    "Liability": {"Home Loan EMI": [], "Credit Card EMI": [], "Personal Loan EMI": [], "Other Loan EMI": []},
    "Asset": {"Real Estate": ["Purchase", "Sale"], "Vehicle": ["Purchase", "Sale"]},
}


def signed_amount(magnitude: Column, kind: Column, sub_category: Column) -> Column:
    """Positive for income and for sub-categories that bring money in, else negative."""
    incoming = (kind == "Income") | F.coalesce(sub_category.isin(POSITIVE_SUB_CATEGORIES), F.lit(False))
    return F.when(incoming, F.abs(magnitude)).otherwise(-F.abs(magnitude))


def editor_options(spark) -> DataFrame:
    rows = [
        (kind, position, category, subs)
        for kind, categories in EDITOR_OPTIONS.items()
        for position, (category, subs) in enumerate(categories.items())
    ]
    return spark.createDataFrame(rows, "type string, position int, category string, sub_categories array<string>")


def valid_edits(edits: DataFrame) -> DataFrame:
    """Edits with a positive magnitude, re-signed from type and sub-category."""
    kept = edits.filter(F.abs("amount") > 0)
    return kept.withColumn("amount", signed_amount(F.col("amount"), F.col("type"), F.col("sub_category")))


def apply_edits(ledger: DataFrame, edits: DataFrame) -> DataFrame:
    """Edit values over stored values; a sub-category the edit leaves empty is kept. Of several edits of a row the last
    counts."""
    fields = ["txn_date", "amount", "type", "category", "sub_category", "merchant"]
    change = last_per_id(edits).select("id", *[F.col(f).alias(f"_e_{f}") for f in fields], F.lit(True).alias("_edited"))
    joined = ledger.join(change, "id", "left")
    values = {f: F.coalesce(f"_e_{f}", f) for f in fields}
    return joined.select(
        *[values.get(c, F.col(c)).alias(c) for c in ledger.columns],
        F.coalesce("_edited", F.lit(False)).alias("is_edited"),
    )


def valid_splits(splits: DataFrame, ledger: DataFrame) -> DataFrame:
    """Split lines, one row each and re-signed, of splits with two or more lines that add up; of several
    such splits of a row the last counts."""
    size = F.size("lines")
    total = F.aggregate(
        "lines", F.lit(0).cast("decimal(38,2)"), lambda acc, line: (acc + F.abs(line["amount"])).cast("decimal(38,2)")
    )
    target = ledger.select(F.col("id").alias("original_id"), F.abs("amount").alias("_target"))
    sound = splits.join(target, "original_id").filter((size >= 2) & (F.abs(total - F.col("_target")) < SPLIT_TOLERANCE))
    lines = last_per_id(sound.select(splits.columns), "original_id").select("original_id", F.posexplode("lines").alias("line_no", "line"))
    return lines.select(
        "original_id",
        "line_no",
        signed_amount(F.col("line.amount"), F.col("line.type"), F.col("line.sub_category")).alias("amount"),
        "line.type",
        "line.category",
        "line.sub_category",
        "line.merchant",
    )


def apply_splits(ledger: DataFrame, lines: DataFrame) -> DataFrame:
    """Originals replaced by their children; a child keeps the original's other columns.

    ``is_child`` is true for the rows made here, and for no stored row: children of earlier splits are rows like others.
    """
    split_ids = lines.select(F.col("original_id").alias("id")).distinct()
    fields = ["amount", "type", "category", "sub_category", "merchant"]
    change = lines.select(F.col("original_id").alias("id"), "line_no", *[F.col(f).alias(f"_l_{f}") for f in fields])
    values = {f: F.col(f"_l_{f}") for f in fields}
    values["merchant"] = F.coalesce("_l_merchant", "merchant")
    values["id"] = F.concat_ws("-", F.lit("split"), "id", F.col("line_no").cast("string"))
    values["split_from_id"] = F.col("id")
    children = ledger.join(change, "id").select(*[values.get(c, F.col(c)).alias(c) for c in ledger.columns], F.lit(True).alias("is_child"))
    return ledger.join(split_ids, "id", "left_anti").withColumn("is_child", F.lit(False)).unionByName(children)


def submitted_page(ledger: DataFrame, edits: DataFrame, splits: DataFrame, page_ids: DataFrame) -> DataFrame:
    """Submit a page: splits replace their originals, edits apply to the rest, page rows become reviewed.

    Children of a split are new rows: they start without links and are checked against the review amount one by one. They
    are told by ``is_child``; stored children of earlier splits keep their status unless the page lists them.
    """
    lines = valid_splits(splits, ledger)
    edited = apply_edits(ledger, valid_edits(edits).join(lines.select(F.col("original_id").alias("id")).distinct(), "id", "left_anti"))
    page = page_ids.select("id").distinct().withColumn("_page", F.lit(True))
    reviewed = edited.join(page, "id", "left").withColumn(
        "status", F.when(F.col("_page"), "user_reviewed").otherwise(F.col("status"))
    )
    split_rows = apply_splits(reviewed.select(*ledger.columns, "is_edited"), lines)
    fresh = {
        "status": F.when(F.abs("amount") >= REVIEW_FLOOR, "pending_review").otherwise("approved"),
        "is_contra": F.lit(False),
        "possible_contra_of": F.lit(None).cast("string"),
        "txn_group_id": F.lit(None).cast("string"),
        "possible_duplicate_of": F.lit(None).cast("string"),
        "duplicate_confidence": F.lit(None).cast("double"),
    }
    return split_rows.withColumns({c: F.when(F.col("is_child"), v).otherwise(F.col(c)) for c, v in fresh.items()})


def apply_page(ledger: DataFrame, edits: DataFrame, splits: DataFrame, page_ids: DataFrame) -> DataFrame:
    """The ledger after a page is submitted and its new children are paired like rows that arrive."""
    return pair_transfers(cut_lineage(submitted_page(ledger, edits, splits, page_ids)), F.col("is_child"), duplicates=False)
