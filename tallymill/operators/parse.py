"""Messages to parsed transactions and balance updates: one narrow pass, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.functions import extract as X
from tallymill.functions.marks import with_marks
from tallymill.functions.text import any_of, first_of, lit, select_sealed, when
from tallymill.operators.fallback import CONFIDENCE, reference_type, with_fallback
from tallymill.operators import rules as rule_list
from tallymill.operators import taxonomy as entries
from tallymill.operators.filters import FAMILIES, with_drop_reason, with_text
from tallymill.operators.rules import RULES, Rule, message_day, with_l2
from tallymill.operators.taxonomy import TAXONOMY, Entry, with_labels
from tallymill.schemas import BALANCE_UPDATES, PARSED, REVIEW_FLOOR

# Sender codes of payment infrastructure, and the discard that carries a balance.
INFRASTRUCTURE_SENDERS = ["NPCI", "UPITRN", "UPITXN", "SBIPSG", "HDFCPAY"]
BALANCE_DISCARD = "balance_disclosure_no_transaction"


def signed(amount: str, direction: str) -> str:
    return first_of([(f"{direction} = 'credit'", f"abs({amount})"), (f"{direction} = 'debit'", f"-abs({amount})")])


def is_infrastructure(address: str) -> str:
    return f"coalesce({any_of(f'upper({address})', INFRASTRUCTURE_SENDERS)}, false)"


def parse_stages(
    messages: DataFrame,
    rules: list[Rule] = RULES,
    taxonomy: list[Entry] = TAXONOMY,
    prefiltered: bool = False,
) -> DataFrame:
    """Every message with its filter verdict, rule outcome and ledger fields, in one wide frame.

    ``stage`` is ``dropped``, ``discard``, ``balance_update``, ``matched``, ``fallback`` or ``escalated``.
    Splits and reports are filters and counts over this frame. With ``prefiltered`` the body filter is
    skipped, as for exports that only hold messages which already passed it.
    """
    families = {**FAMILIES, **X.FAMILIES, **entries.families(taxonomy), **rule_list.families(rules)}
    texts, marks = with_marks(with_text(messages), families)
    filtered = (
        texts.selectExpr("*", "CAST(NULL AS string) AS drop_reason") if prefiltered else with_drop_reason(texts, marks)
    )
    fallen = with_fallback(with_l2(filtered, rules, marks), "outcome = 'none'")

    def pick(rule_field: str, fallback_field: str) -> str:
        return f"CASE outcome WHEN 'matched' THEN {rule_field} WHEN 'none' THEN {fallback_field} END"

    merged = fallen.selectExpr(
        "*",
        f"{pick('direction', 'fb_direction')} AS _direction",
        f"{pick('amount', 'fb_amount')} AS _amount",
        f"{pick('channel', 'fb_channel')} AS _channel",
        f"{pick('merchant', 'fb_merchant')} AS _merchant",
        f"{pick('account_number_masked', 'fb_account')} AS _account",
        f"coalesce(discard_reason = {lit(BALANCE_DISCARD)}, false) AS _balance_row",
        f"{message_day('date')} AS message_date",
        "try_cast(txn_date_raw AS date) AS _text_day",
    )
    known = "outcome IN ('matched', 'none') AND _amount IS NOT NULL AND _direction IS NOT NULL"
    labelled = with_labels(merged, known, "_low", "(_direction = 'credit')", "_amount", "_channel", taxonomy, marks)

    failure = first_of(
        [
            ("outcome = 'discard' AND NOT _balance_row", "discard_reason"),
            ("outcome <> 'none'", "NULL"),
            ("fb_amount IS NULL", lit("missing_amount")),
            ("fb_direction IS NULL", lit("unknown_direction")),
            ("category IS NULL", lit("escalated_to_haiku")),
        ]
    )
    unsure = "(outcome = 'matched' AND (requires_classification OR _mandate_guess))"
    judged = labelled.selectExpr("*", f"{failure} AS parse_failure", f"{unsure} AS _unsure")
    stage = first_of(
        [
            ("outcome = 'dropped'", lit("dropped")),
            ("_balance_row", lit("balance_update")),
            ("outcome = 'discard'", lit("discard")),
            ("outcome = 'matched'", lit("matched")),
            ("parse_failure IS NULL", lit("fallback")),
        ],
        lit("escalated"),
    )
    needs_review = f"parse_failure IS NOT NULL OR _account IS NULL OR _amount >= {REVIEW_FLOOR} OR _unsure"
    columns = {
        "drop_reason": "drop_reason",
        "rule_id": "CASE WHEN outcome <> 'none' THEN rule_id END",
        "outcome": "outcome",
        "stage": stage,
        "message_date": "message_date",
        "txn_date": "CASE WHEN outcome = 'matched' THEN coalesce(_text_day, message_date) ELSE message_date END",
        "txn_date_invalid": "outcome = 'matched' AND txn_date_raw IS NOT NULL AND _text_day IS NULL",
        "amount": signed("_amount", "_direction"),
        "direction": "_direction",
        "type": "type",
        "category": "category",
        "sub_category": "sub_category",
        "merchant": "_merchant",
        "merchant_key": X.merchant_key("_merchant"),
        "status": f"CASE WHEN {needs_review} THEN 'pending_review' ELSE 'approved' END",
        "account_number_masked": "CASE WHEN _balance_row THEN account_number_masked ELSE _account END",
        "bank": when("_balance_row", "bank", pick("bank", "fb_bank")),
        "channel": "_channel",
        "balance": when("_balance_row", "balance", pick("balance", "fb_balance")),
        "ref_number": pick("ref_number", "coalesce(fb_transfer_ref, fb_payment_ref)"),
        "ref_type": pick("ref_type", reference_type()),
        "matched_rule": "CASE WHEN outcome = 'matched' THEN rule_id END",
        "confidence": f"CASE WHEN outcome = 'matched' THEN confidence "
        f"WHEN outcome = 'none' AND parse_failure IS NULL THEN {lit(CONFIDENCE)} END",
        "requires_classification": "_unsure",
        "possible_contra": "outcome = 'matched' AND possible_contra",
        "vpa_type": "CASE WHEN outcome = 'matched' THEN vpa_type END",
        "is_infrastructure": is_infrastructure("address"),
        "parse_failure": "parse_failure",
    }
    return select_sealed(judged, messages.columns, columns)


def transactions_of(staged: DataFrame) -> DataFrame:
    """The 26-column transaction rows of a staged frame, failures and escalations included."""
    extra = [F.col("user_id")] if "user_id" in staged.columns else []
    fixed = {
        "kind": F.lit("transaction"),
        "raw_sms_id": F.col("id"),
        "source": F.lit("sms"),
        "txn_group_id": F.lit(None),
        "health_module_tag": F.lit(None),
        "raw_text": F.col("body"),
    }
    columns = [fixed.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in PARSED.fields]
    return staged.filter(F.col("stage").isin("matched", "fallback", "escalated", "discard")).select(
        *extra, *columns, F.timestamp_millis(F.col("date")).alias("message_time")
    )


def balance_updates_of(staged: DataFrame) -> DataFrame:
    extra = [F.col("user_id")] if "user_id" in staged.columns else []
    fixed = {"kind": F.lit("balance_update"), "raw_sms_id": F.col("id")}
    columns = [fixed.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in BALANCE_UPDATES.fields]
    return staged.filter(F.col("stage") == "balance_update").select(
        *extra, *columns, F.timestamp_millis(F.col("date")).alias("message_time")
    )


def parse_messages(
    messages: DataFrame, rules: list[Rule] = RULES, taxonomy: list[Entry] = TAXONOMY
) -> tuple[DataFrame, DataFrame]:
    """``(transactions, balance_updates)``. Write the staged frame first if both are to be stored:
    each of the two is its own pass over the messages otherwise."""
    staged = parse_stages(messages, rules, taxonomy)
    return transactions_of(staged), balance_updates_of(staged)
