"""Explicit schemas; nothing in this package infers one."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY_TYPE = T.DecimalType(38, 2)


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "decimal(38,2)": MONEY_TYPE,
    "array<string>": T.ArrayType(T.StringType()),
}


def struct_of(spec: str) -> T.StructType:
    """Schema from ``name type`` pairs; unlike DDL parsing this needs no running session."""
    pairs = [part.split() for part in spec.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


MESSAGES = struct_of("id string, user_id string, address string, body string, date bigint")

RAW_EXPORT = struct_of(
    "generated_at string, window string, from_days_ago int, to_days_ago int, total_count int"
).add("messages", T.ArrayType(struct_of("id string, address string, date string, body string")))

PARSED_COLUMNS = (
    "kind string, raw_sms_id string, txn_date date, amount decimal(38,2), type string, category string, "
    "sub_category string, merchant string, merchant_key string, source string, status string, "
    "account_number_masked string, bank string, channel string, balance decimal(38,2), ref_number string, "
    "ref_type string, matched_rule string, confidence double, requires_classification boolean, "
    "possible_contra boolean, txn_group_id string, is_infrastructure boolean, health_module_tag array<string>, "
    "parse_failure string, raw_text string"
)
PARSED = struct_of(PARSED_COLUMNS)

BALANCE_UPDATES = struct_of(
    "kind string, raw_sms_id string, account_number_masked string, bank string, balance decimal(38,2), "
    "message_date date"
)

PARSER_REPORT = T.StructType(
    [
        T.StructField("generated_at", T.StringType()),
        T.StructField("window", T.StringType()),
        T.StructField(
            "transactions", T.ArrayType(struct_of("address string, user_id string, " + PARSED_COLUMNS))
        ),
        T.StructField("balance_updates", T.ArrayType(BALANCE_UPDATES)),
    ]
)

ACCOUNTS = struct_of(
    "id string, user_id string, account_type string, institution_name string, account_number_masked string, "
    "balance_latest decimal(38,2), balance_updated_at date, aa_linked boolean, is_active boolean"
)

LEDGER = struct_of(
    "id string, user_id string, account_id string, txn_date date, amount decimal(38,2), type string, "
    "category string, sub_category string, merchant string, merchant_key string, source string, status string, "
    "reviewed_at timestamp, raw_text string, is_deleted boolean, split_from_id string, added_late boolean, "
    "after_report_month string, is_contra boolean, possible_contra_of string, duplicate_confidence double, "
    "possible_duplicate_of string, health_module_tag array<string>, ref_number string, ref_type string, "
    "txn_group_id string, is_infrastructure boolean, created_at timestamp"
)

EDITS = struct_of(
    "id string, txn_date date, amount decimal(38,2), type string, category string, sub_category string, "
    "merchant string"
)

SPLIT_LINE = "struct<amount: decimal(38,2), type: string, category: string, sub_category: string, merchant: string>"
SPLITS = struct_of("original_id string").add(
    "lines",
    T.ArrayType(
        struct_of("amount decimal(38,2), type string, category string, sub_category string, merchant string")
    ),
)

MODEL_ANSWER = struct_of(
    "is_promotional boolean, direction string, amount double, type string, category string, "
    "sub_category string, merchant string, account_number_masked string, txn_date string, ref_number string, "
    "ref_type string, vpa string, vpa_type string, confidence double, requires_classification boolean, "
    "possible_contra boolean, bank string"
)

# The closed vocabularies of the ledger.
TXN_TYPES = ["Expense", "Income", "Investment", "Liability", "Asset"]
STATUSES = ["pending_review", "approved", "user_reviewed"]
SOURCES = ["sms", "email", "manual", "pdf", "cash", "haiku"]
REF_TYPES = ["upi_rrn", "neft_utr", "unknown"]
UNKNOWN_ACCOUNT = "UNKNOWN"
REVIEW_FLOOR = 5000
