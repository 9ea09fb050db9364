"""Deterministic message and ledger tables derived from the star-schema test tables.

A message template is text with ``{amt} {a4} {rrn} {d} {dmy} {dm} {leg}`` slots filled from an order row, so
the right parse of every message is known from the order itself.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tallymill.functions.text import lit
from tallymill.operators.skew import at_least_one_partition_per_core

DEFAULT_SENDER = "VM-DEMOBK-S"
MONTHS_AHEAD = 300

# Templates by number. 1-26 are one per rule, 27-30 the fallback cases, 31-41 noise.
TEMPLATES: dict[int, str] = {
    1: "Your txn of Rs.{amt} on A/c XX{a4} was declined on {d}. -Demo Bank",
    2: "Your Credit Card XX{a4} purchase of Rs.{amt} has been converted to 12-month EMI effective {d}. -Demo Bank",
    3: "Available Bal in Demo Bank A/c XX{a4} as on yesterday:{d} is INR {amt}.",
    4: "Txn Rs.{amt}\nOn Demo Bank Card {a4}\nAt NORTH MART\nby UPI {rrn}\nOn {dm}",
    5: "Alert!\nPaid Rs. {amt}\nFor: Credit Card payment\nFrom Demo Bank A/c XX{a4}\nVia Online Banking.",
    6: "Rs. {amt} spent from DemoMeal Meal Card wallet, card no.xx{a4} on {d} at NORTH MART. Avl bal Rs.2500.00.",
    7: "Your DemoMeal Card has been successfully credited with Rs.{amt} towards Meal Wallet on {d}.",
    8: "Your NCMC Prepaid Card 600000XXXXXX{a4} is loaded with Rs. {amt} successfully on {dmy}. -Demo Bank",
    9: "Rs.{amt} paid to NORTH MART from your DemoPay Wallet on {d}.",
    10: "Payment Successful!\nRs. {amt} from A/c XX{a4} to NORTH TRADERS via Demo Bank NetBanking.",
    11: "Rs.{amt} debited from A/c XX{a4} on {d} towards NORTH FINANCE UMRN DEMO00000001. -Demo Bank",
    12: "Rs.{amt} transferred to your PPF A/c from A/c XX{a4} on {d}.",
    13: "Loan amount Rs.{amt} disbursed to A/c XX{a4} on {d}. -Demo Bank",
    14: "Cheque No 123456 for Rs.{amt} has been cleared from A/c XX{a4} on {d}. -Demo Bank",
    15: "Your Demo Bank Debit Card X{a4} used for Rs.{amt} at NORTH MART on {d}.",
    16: "Trip completed. Rs.{amt} charged for your Demo ride on {d}.",
    17: "Cash deposit of Rs.{amt} in A/c XX{a4} via CDM on {d}. Avl Bal Rs.9000.00.",
    18: "Rs.{amt} added to your DemoPay Wallet on {d} from linked bank account.",
    19: "You paid Rs.{amt} to North Traders using DemoPay on {d}. UPI transaction ID {rrn}.",
    20: "Demo DTH Recharge of Rs.{amt} successful on {d}.",
    21: "Demand Draft No 10000001 for Rs.{amt} has been issued against A/c XX{a4} on {d}. -Demo Bank",
    22: "AC XX{a4} DR RS.{amt} ON {leg} AVBL BAL RS.5000.00 -DB",
    23: "DemoCourier: Rs.{amt} collected as COD payment for your shipment delivered on {d}. Thank you!",
    24: "Refund of Rs.{amt} for your returned shoes order initiated. Amount will reflect in A/c XX{a4} in 5-7 business days.",
    25: "Rs.{amt} debited from A/c XX{a4} on {d} to NORTH MART Ref {rrn}. -Demo Bank",
    26: "Rs.{amt} credited to A/c XX{a4} on {d} from VPA demo.user@okdemo (UPI {rrn}).",
    27: "Fee payment of Rs.{amt} to North School successful from A/c XX{a4} on {d}.",
    28: "Netflix purchase of Rs.{amt} from card ending {a4}.",
    29: "Rs.{amt} loan amount ready for you.",
    30: "Dividend of 50 paise per share has been credited on 23.02.2026.",
    33: "123456 is the one time password for your txn of Rs.{amt}.",
    34: "Your shipment is out for delivery today.",
    35: "Recharge now to keep your plan active.",
    36: "Rs.{amt} will\nbe credited to A/c XX{a4} soon.",
    37: "500 reward points have been credited to you.",
    38: "Pre-approved offer of Rs.{amt}. Apply now http://bit.ly/demo",
    39: "Minimum due: Rs.{amt} on your monthly summary.",
    40: "Hello, a voucher worth Rs.{amt} is waiting.",
    41: "We have received Rs.{amt}. Payment received with thanks.",
}
TEMPLATES[31] = TEMPLATES[32] = TEMPLATES[25]
SENDERS = {31: "AD-DEMOBK-P", 32: "5551234"}
TEMPLATE_COUNT = 41

QUIRKS: dict[str, str] = {
    "balance_before_load": TEMPLATES[8] + " Available balance is Rs. 1100.00.",
    "spent_with_paise": "Spent Rs.{amt} On Demo Bank Card {a4} At NORTH MART On {d}",
    "paid_for": "DemoShow: Rs.{amt} paid for 2 tickets. Booking confirmed",
    "dashed_date": "Rs.{amt} debited from A/c XX{a4} on 03-10-2024.",
}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# The slots of an order row, by name.
SLOTS = {
    "amt": "format_string('%.2f', o_totalprice)",
    "a4": "lpad(o_custkey % 10000, 4, '0')",
    "rrn": "CAST(100000000000 + o_orderkey AS string)",
    "d": "date_format(day, 'dd-MMM-yyyy')",
    "dmy": "date_format(day, 'dd/MM/yyyy')",
    "dm": "date_format(day, 'dd-MM')",
    "leg": "upper(date_format(day, 'ddMMMyy'))",
}


def render(template: str) -> str:
    """SQL text of a template over an order row whose slots are columns."""
    parts = [p[1:-1] if p.startswith("{") else lit(p) for p in re.split(r"(\{\w+\})", template) if p]
    return f"concat({', '.join(parts)})"


def _messages(orders: DataFrame, body: str, address: str) -> DataFrame:
    days = orders.selectExpr("*", f"add_months(to_date(o_orderdate), {MONTHS_AHEAD}) AS day")
    slots = days.selectExpr("*", *[f"{sql} AS {name}" for name, sql in SLOTS.items()])
    return slots.selectExpr(
        "CAST(o_orderkey AS string) AS id",
        "CAST(o_custkey AS string) AS user_id",
        f"{address} AS address",
        f"{body} AS body",
        "unix_millis(CAST(day AS timestamp) + INTERVAL 12 HOURS) AS date",
    )


def inbox(orders: DataFrame) -> DataFrame:
    """A mixed inbox: every order becomes one message, its key picks the template."""
    number = f"o_orderkey % {TEMPLATE_COUNT} + 1"
    bodies = " ".join(f"WHEN {n} THEN {render(TEMPLATES[n])}" for n in sorted(TEMPLATES))
    senders = " ".join(f"WHEN {n} THEN {lit(sender)}" for n, sender in SENDERS.items())
    return _messages(
        orders, f"CASE {number} {bodies} END", f"CASE {number} {senders} ELSE {lit(DEFAULT_SENDER)} END"
    )


def messages_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inbox(at_least_one_partition_per_core(load(spark, sf_dir, "orders"), "o_orderkey"))


def template_messages(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    """Every order rendered through one template."""
    orders = at_least_one_partition_per_core(load(spark, sf_dir, "orders"), "o_orderkey")
    return _messages(orders, render(template), lit(DEFAULT_SENDER))


def ledger_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_from(load(spark, sf_dir, "events"))


def ledger_from(events: DataFrame) -> DataFrame:
    """A ledger with transfers, repeats, reviewed rows, infrastructure rows and rows of no value: one row per event."""
    return events.selectExpr(
        "CAST(event_id AS string) AS id",
        "CAST(user_id AS string) AS user_id",
        "concat('A', event_id % 3) AS account_id",
        "to_date(ts) AS txn_date",
        "CAST(CASE WHEN event_type IN ('purchase', 'error') THEN -floor(value) ELSE floor(value) END "
        "AS decimal(38,2)) AS amount",
        "CASE WHEN event_id % 4 < 2 THEN concat(user_id, '-', CAST(floor(value) AS bigint)) END AS ref_number",
        "CASE WHEN event_id % 5 = 0 THEN 'user_reviewed' WHEN event_id % 5 < 3 THEN 'pending_review' "
        "ELSE 'approved' END AS status",
        "false AS is_deleted",
        "event_id % 50 = 7 AS is_infrastructure",
        "event_id % 40 = 11 AS is_contra",
        "CASE event_type WHEN 'signup' THEN 'income' WHEN 'purchase' THEN 'shopping' ELSE event_type END AS category",
        "CAST(NULL AS string) AS sub_category",
        "CASE WHEN event_type = 'purchase' THEN 'Expense' ELSE 'Income' END AS type",
        "CASE WHEN event_id % 3 = 0 THEN concat('Shop ', event_id % 7) END AS merchant",
        "'sms' AS source",
        "CAST(NULL AS string) AS ref_type",
        "CAST(NULL AS string) AS split_from_id",
        "CAST(NULL AS string) AS possible_contra_of",
        "CAST(NULL AS string) AS txn_group_id",
        "CAST(NULL AS string) AS possible_duplicate_of",
        "CAST(NULL AS double) AS duplicate_confidence",
        "ts AS created_at",
    )


def matches_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule matches with repeated references, texts and values: one per line item. Every tenth order is in two inboxes, under
    equal ids."""
    lines = load(spark, sf_dir, "lineitem").selectExpr(
        "*", "explode(CASE WHEN l_orderkey % 10 = 0 THEN array('', 'twin-') ELSE array('') END) AS inbox"
    )
    return lines.selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS bigint)) AS id",
        "concat(inbox, l_suppkey) AS user_id",
        "concat('  item ', l_partkey, ' ') AS body",
        "CASE l_linenumber WHEN 1 THEN 'GENERIC_DEBIT' WHEN 2 THEN 'GENERIC_CREDIT' ELSE 'CASH_DEPOSIT' END AS rule_id",
        "CAST(l_quantity AS decimal(38,2)) AS amount",
        "trunc(l_shipdate, 'MM') AS txn_date",
        "CASE WHEN l_linenumber < 6 THEN CAST(l_suppkey % 3 AS string) END AS account_number_masked",
        "CASE WHEN l_orderkey % 2 = 0 THEN CAST(l_partkey AS string) END AS ref_number",
        "CASE WHEN l_orderkey % 2 = 0 THEN 'upi_rrn' END AS ref_type",
        "unix_millis(CAST(l_shipdate AS timestamp)) AS date",
    )
