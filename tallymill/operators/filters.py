"""Sender and body filters: one ordered CASE whose value is the first failing reason."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallymill.functions.marks import Marks, ask, marked, phrases
from tallymill.functions.text import (
    all_of,
    any_of,
    both,
    contains,
    either,
    first_of,
    has,
    lit,
    normalise_blanks,
    select_sealed,
)

# Phrases and patterns of the body filter, matched on lower-cased text.
OTP = [
    "otp", "one time password", "verification code", "do not share", "do not disclose", "never share",
    "confidential code", "login code", "sign in code", "authentication code", "is your otp", "is the otp",
]
CURRENCY = ["rs.", "rs ", "inr", "₹"]
DELIVERY = [
    "out for delivery", "shipment", "your order has been", "pickup scheduled", "courier", "tracking id",
    "dispatched", "order confirmed", "order placed",
]
TELECOM = [
    "pack expir", "recharge today", "recharge now", "your pack", "data pack", "missed call", "misted call",
    "voicemail", "voice mail", "call back", "call alert",
]
FUTURE_CREDIT = r"will\s+be\s+(?:credited|processed|refunded)"
LOYALTY = r"(?:points|coins|reward\s+points)\s.*credited|credited\s.*(?:points|coins|reward\s+points)"
OFFER = [
    "pre-approved", "lifetime free", "t&c", "tap to", "tap here", "click here", "apply now", "avail now",
    "get upto", "get up to", "flat 5%", "5% cashback", "reward points", "free tickets", "limited time",
    "offer ends",
]
PROMO_URL = [
    "kotak.bank.in", "hdfc.bank.in", "hdfcbk.io", "airtelxstream", "airtel.in/", "bookmyshow.com",
    "vivoignite.com",
]
PROMO_SHORT_URL = [["http", "bit.ly"], ["http", "gs.im"]]
PROMO_ACCOUNT = [r"[ax][x/]\d{4}", r"a/c\s*[x*]{1,6}\d{4}", r"card\s+\d{4}"]
SERVICE = [
    "power cut", "power outage", "will be restored", "மின்தடங்கல்", "ரீசார்ஜ்", "மிஸ்டு கால்",
    "beware dealing on unsolicited", "attention_investors", "locker access", "locker branch",
    "on-board food menu", "menurates.irctc", "boarding allowed", "trai dnd", "sanchar saathi", "mobile tower",
    "total due:", "min.due:", "minimum due:", "cashless claim", "epfo youtube",
]
SERVICE_TOGETHER = [
    ["credit card", "pay by", "statement"],
    ["amount due", "credit card", "pay instantly"],
    ["traded value", "cm rs"],
    ["trade confirmation", "value rs"],
    ["fund bal", "securities bal"],
    ["passbook balance", "contribution"],
    ["please complete the transaction", "link is valid"],
]
SERVICE_FARE = r"fare:\d+"
CLAIM_STATUS = ["clarification", "additional info", "received your cashless", "processed your cashless"]
FUND_CONTRIBUTION = ["pf contribution", "epf contribution"]
FUND_CREDITED = ["credited to your pf", "credited to your epf", "passbook"]
BARE_MONEY = r"\d{1,3}(,\d{3})*\.\d{2}"
DIRECTION = [
    "debited", "credited", "deducted", "withdrawn", "deposited", "transferred", "sent rs", "sent inr", "sent ₹",
    "spent", "received rs", "received inr", "received ₹", "payment of", "payment alert", "paid to", "paid rs",
    "paid inr", "refund", "reversal", "reversed", "salary", "credit alert", "debit alert", "txn alert",
    "transaction alert", "purchase of", "payment received", "amount debited", "amount credited", "avl bal",
    "available bal", "balance after", "declined", "txn failed", "transaction failed", "payment failed",
    "txn rs.", "has been used for", "has been charged", "spent on", "is successful", "was successful",
    "payment successful", "paid towards", "is loaded with", "spent from", "successfully credited with",
    "withdrawal", "collected as", "disbursed", "added to", "used for", "charged to", "charged for", "paid via",
    "paid for", "paid at", "cleared", "purchased successfully", "cash deposit", "recharge of",
    "recharged with", "issued against", "loan amount", "successful", "failed",
]
DIRECTION_WDL = r"\<wdl\>"
DIRECTION_LEGACY = r"\<ac\s+[x*]{1,4}\d{4}\s+(?:dr|cr)\s+rs\.?\s*\d"
DIRECTION_USING_CARD = r"using\s+\w[\w\s]*card\s+\w*\s*for\s+rs"
BANK_ACCOUNT = [
    r"[ax][x*/]\d{4}", r"a/c\s*(?:no\.?)?\s*[x*]{0,4}\d{4}", r"card\s+[x*]?\d{4}", r"account\s+[x*]{1,4}\d{4}",
]
ACKNOWLEDGED = [
    "thank you for your payment", "payment received", "amount received", "premium received", "fee received",
    "we have received", "received your payment",
]

# Ground-truth phrases that mark promotions and noise in evaluation runs.
KNOWN_PROMO = ["kotak.bank.in", "airtelxstream", "vivoignite", "krishnayan", "pvrinox.com"]
KNOWN_NOISE = [
    "மின்தடங்கல்", "மிஸ்டு கால்", "ரீசார்ஜ் பேக் முடிகிறது", "menurates.irctc", "solemate account",
    "locker access", "locker branch", "trai dnd", "attention_investors", "on-board food menu",
    "bseindia.com", "sanchar saathi", "vivoignite", "subject to reconciliation", "tnebnet.org",
]


def sender_dropped(address: str) -> str:
    """Missing sender, promotional suffix, or an all-digit sender."""
    return (
        f"(coalesce({address}, '') = '' OR endswith(upper({address}), '-P') "
        f"OR {has(address, r'^[0-9]+\z', '')})"
    )


def has_currency_marker(low: str) -> str:
    return either([any_of(low, CURRENCY), has(low, r"rs\d", "")])


#: What a text must hold for any test of a family; see ``functions/marks``.
FAMILIES = {
    "noise": phrases(
        OTP + DELIVERY + TELECOM + OFFER + SERVICE + [group[-1] for group in SERVICE_TOGETHER]
        + ["will", "fare:", "claim", *FUND_CONTRIBUTION]
    ),
    "direction": phrases(DIRECTION),
    "acknowledged": phrases([*ACKNOWLEDGED, "recharge", "has been activated"]),
}


def body_drop_reason(low: str, marks: Marks | None = None) -> str:
    """First failing body test on lower-cased, blank-normalised text; null means the body passes. ``marks`` tells
    the families a text may hold, if that is known."""
    promo_url = either([any_of(low, PROMO_URL)] + [all_of(low, pair) for pair in PROMO_SHORT_URL])
    promo_account = either(
        [has(low, p, "") for p in PROMO_ACCOUNT]
        + [both([contains(low, "your account"), any_of(low, ["debited", "credited"])])]
    )
    service = either(
        [any_of(low, SERVICE)]
        + [all_of(low, group) for group in SERVICE_TOGETHER]
        + [
            both([contains(low, "fare:"), has(low, SERVICE_FARE, "")]),
            both([contains(low, "claim"), any_of(low, CLAIM_STATUS)]),
            both([any_of(low, FUND_CONTRIBUTION), any_of(low, FUND_CREDITED)]),
        ]
    )
    currency = either([has_currency_marker(low), has(low, BARE_MONEY, "")])
    direction = either(
        [
            any_of(low, DIRECTION) if marks is None else marked(marks, "direction"),
            both([contains(low, "wdl"), has(low, DIRECTION_WDL, "")]),
            has(low, DIRECTION_LEGACY, ""),
            both([contains(low, "using"), has(low, DIRECTION_USING_CARD, "")]),
        ]
    )
    acknowledged = either(
        [
            any_of(low, ACKNOWLEDGED),
            all_of(low, ["is successful", "recharge"]),
            both([contains(low, "has been activated"), any_of(low, ["inr", "rs."])]),
        ]
    )
    account = either([has(low, p, "") for p in BANK_ACCOUNT])

    def noise(test: str) -> str:
        return ask(marks, "noise", test)

    return first_of(
        [
            (noise(any_of(low, OTP)), lit("otp")),
            (noise(both([any_of(low, DELIVERY), f"NOT {has_currency_marker(low)}"])), lit("delivery")),
            (noise(any_of(low, TELECOM)), lit("telecom")),
            (noise(both([contains(low, "will"), has(low, FUTURE_CREDIT, "")])), lit("future_credit")),
            (both([contains(low, "credited"), has(low, LOYALTY, "")]), lit("loyalty")),
            (noise(both([any_of(low, OFFER), promo_url, f"NOT {promo_account}"])), lit("promo")),
            (noise(service), lit("service_noise")),
            (f"NOT {both([currency, direction])}", lit("no_signal")),
            (ask(marks, "acknowledged", both([acknowledged, f"NOT {account}"])), lit("payee_ack")),
        ]
    )


def is_known_promo(low: str) -> str:
    return either(
        [
            any_of(low, KNOWN_PROMO),
            both([contains(low, "pre-approved"), f"NOT {any_of(low, ['a/c', 'xx'])}"]),
            both([contains(low, "airtel.in/"), f"NOT {any_of(low, ['successful', 'debited'])}"]),
        ]
    )


def is_known_noise(low: str) -> str:
    passenger = any_of(low, ["boarding allowed", "dear passenger"])
    return either([any_of(low, KNOWN_NOISE), both([passenger, f"NOT {contains(low, 'rs')}"])])


def with_text(messages: DataFrame) -> DataFrame:
    """Add the two working columns every text test reads."""
    return messages.selectExpr("*", f"{normalise_blanks('body')} AS _text").selectExpr("*", "lower(_text) AS _low")


def drop_reason(marks: Marks | None = None) -> str:
    """``sender``, a body reason, or null for a message that passes."""
    return first_of(
        [(sender_dropped("address"), lit("sender")), ("body IS NULL", lit("no_signal"))], body_drop_reason("_low", marks)
    )


def with_drop_reason(texts: DataFrame, marks: Marks | None = None) -> DataFrame:
    return texts.selectExpr("*", f"{drop_reason(marks)} AS drop_reason")


def filter_messages(messages: DataFrame) -> DataFrame:
    """Every message with its ``drop_reason``; keep the rows where it is null to filter."""
    return select_sealed(with_text(messages), messages.columns, {"drop_reason": drop_reason()})
