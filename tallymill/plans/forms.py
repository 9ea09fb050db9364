"""Texts that each order is written in, one form an order, and the fields that have to be read from them.

Order ``o_orderkey`` gets form ``o_orderkey % n`` of a list. ``amt``, ``a4`` and slots in braces stand for values of the order; the expected
fields are written out here, so the answers need neither the patterns nor the texts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from tallymill.functions.text import lit
from tallymill.plans.samples import MONTHS_AHEAD, SLOTS, render

# The figure behind INR comes before one behind Rs, whatever their order in the text.
FIELDS = ["amount", "direction", "account", "balance", "merchant", "bank", "channel", "ref_number", "ref_type"]
FALLBACK = [
    ("INR {amt} charged at North Store, Avl Bal: Rs.750.25", ("amt", "debit", None, 750.25, "North Store", None, None, None, None)),
    ("Rs. {amt} deposited by transfer from north.user@ybl today via IMPS", ("amt", "credit", None, None, "north.user", "PhonePe / Yes Bank", "IMPS", None, None)),
    ("₹{amt} credited by HDFC, UTR: demo{rrn}", ("amt", "credit", None, None, None, "HDFC Bank", None, "DEMO{rrn}", "neft_utr")),
    ("{amt} debited from card {a4} towards North School, RRN {rrn}", ("amt", "debit", "{a4}", None, "North School", None, None, "{rrn}", "upi_rrn")),
    ("Rs.{amt} paid via demo POS at Union Bank outlet, A/c bal INR 12.50. Transaction ID: {rrn}",
     (12.5, "debit", None, 12.5, "Union Bank outlet", "Union Bank of India", "POS", "{rrn}", "upi_rrn")),
    ("Balance is Rs. 30.5 in wallet of A/c no. {a4}. Rs.{amt} deducted; refund and cashback follow", (30.5, "credit", "{a4}", 30.5, None, None, "Wallet", None, None)),
    ("Salary of Rs.{amt} and charged Rs.9 at North Gate for cash use by UPI Ref No {rrn}", ("amt", "debit", None, None, "North Gate", None, "UPI", "{rrn}", "upi_rrn")),
    ("Nothing to see here", (None,) * 9),
    ("Rs.0 then INR {amt} transferred to x1@idfc on {d} ref DEMO{rrn}55", ("amt", "debit", None, None, "x1", "IDFC First Bank", None, "DEMO{rrn}55", "neft_utr")),
    ("AC no {a4} credited with Rs.{amt}. Avl. Bal Rs.1,250.75 - AU BANK credit card", ("amt", "credit", "{a4}", 1250.75, None, "AU Small Finance Bank", "Credit Card", None, None)),
    ("{a4} has been debited by Rs.{amt} via NEFT no: demo{rrn}9", ("amt", "debit", "{a4}", None, None, None, "NEFT", "DEMO{rrn}9", "neft_utr")),
]

# merchant, payment reference, transfer reference
CLAUSES = [
    ("Paid Rs.5\nTo North Shop\nOn 05-06", ("North Shop", None, None)), ("to IB FUNDS TRANSFER on 5 at Mall On x", (None, None, None)),
    ("spent at Corner Cafe on 5 June", ("Corner Cafe", None, None)), ("towards Power Co UMRN: DEMO{rrn}", ("Power Co", None, "DEMO{rrn}")),
    ("towards your credit card ending 1234. Thanks", (None, None, None)), ("NEFT transfer from NORTH TRADERS Ref {rrn}", ("NORTH TRADERS", "{rrn}", None)),
    ("credited from VPA demo.user-1@okdemo (UPI {rrn})", ("demo.user-1@okdemo", "{rrn}", None)), ("Info: North Salary May. Avl Bal Rs.5", ("North Salary May", None, None)),
    ("Info: IB FUNDS TRANSFER 7. Avl Bal Rs.5", (None, None, None)), ("to North Shop on x, payment has been reversed", (None, None, None)),
    ("to North Shop Ref 9; UTR demo{rrn}", ("North Shop", None, "demo{rrn}")), ("Info: Rent", ("Rent", None, None)), ("nothing", (None, None, None)),
    ("fee to North School successful from A/c", ("North School", None, None)), ("To Corner Store from A/c XX1", ("Corner Store", None, None)),
    ("to friend via app", ("friend", None, None)), ("towards Club Mandate 5", ("Club", None, None)),
    ("Info: A merchant whose name goes on for more than forty signs. Avl Bal Rs.5", ("A merchant whose name goes on for more than forty signs", None, None)),
    ("to a friend, refund: reversal of {rrn}", (None, None, None)), ("RRN: {rrn} at Shop & Co on 5", ("Shop & Co", "{rrn}", None)), ("UTR DEMO123", (None, None, None)),
]

SENDERS = [
    ("VM-NPCI-S", True), ("ad-upitrn", True), ("VM-UPITXN", True), ("jd-sbipsg", True), ("VM-HDFCPAY-S", True),
    ("VM-HDFCBK-S", False), ("NP-CI", False), (None, False),
]


def written(orders: DataFrame, forms: list[tuple]) -> DataFrame:
    """o_orderkey and body: each order in its form."""
    days = orders.selectExpr("*", f"add_months(to_date(o_orderdate), {MONTHS_AHEAD}) AS day")
    slots = days.selectExpr("*", *[f"{sql} AS {name}" for name, sql in SLOTS.items()])
    texts = " ".join(f"WHEN {i} THEN {render(text)}" for i, (text, _) in enumerate(forms))
    return slots.selectExpr("o_orderkey", f"CASE o_orderkey % {len(forms)} {texts} END AS body")


def senders(customers: DataFrame) -> DataFrame:
    names = " ".join(f"WHEN {i} THEN {lit(name) if name else 'CAST(NULL AS string)'}" for i, (name, _) in enumerate(SENDERS))
    return customers.selectExpr("c_custkey", f"CASE c_custkey % {len(SENDERS)} {names} END AS address")


def expected(values: list, key: str) -> str:
    """SQL value by the number of a row's form; slots are columns."""

    def q(value) -> str:
        if value is None or isinstance(value, bool):
            return {None: "NULL", True: "true", False: "false"}[value]
        if isinstance(value, float) or value == "amt":
            return str(value)
        parts = [p[1:-1] if p.startswith("{") else "'" + p.replace("'", "''") + "'" for p in re.split(r"(\{\w+\})", value) if p]
        return " || ".join(parts)

    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values)) + " END"
