"""Keyword fallback for messages no rule explains."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallymill.functions.text import (
    MONEY,
    array,
    coalesce,
    first_hit,
    first_money,
    first_of,
    gated_grab,
    grab,
    lit,
    strip,
    when,
)

# Fallback keywords and maps.
DEBIT_WORDS = [
    "debited", "deducted", "withdrawn", "withdrawal", "spent", "payment of", "transferred to", "sent to",
    "purchase", "charged", "emi due", "emi paid", "emi deducted", "premium of", "paid to", "paid via",
    "paid for", "paid towards", "used for", "cleared",
]
CREDIT_WORDS = [
    "credited", "received", "deposited", "refund", "salary", "reversed", "cashback", "added to",
    "transfer from", "disbursed", "neft cr", "imps cr", "ach credit",
]
BANK_WORDS = [
    ("HDFC", "HDFC Bank"),
    ("ICICI", "ICICI Bank"),
    ("SBI", "State Bank of India"),
    ("AXIS", "Axis Bank"),
    ("KOTAK", "Kotak Mahindra Bank"),
    ("YES BANK", "Yes Bank"),
    ("YESBANK", "Yes Bank"),
    ("PNB", "Punjab National Bank"),
    ("BOB", "Bank of Baroda"),
    ("CANARA", "Canara Bank"),
    ("IDFC", "IDFC First Bank"),
    ("INDUSIND", "IndusInd Bank"),
    ("FEDERAL", "Federal Bank"),
    ("RBL", "RBL Bank"),
    ("UNION BANK", "Union Bank of India"),
    ("PAYTM", "Paytm Payments Bank"),
    ("AIRTEL", "Airtel Payments Bank"),
    ("AU BANK", "AU Small Finance Bank"),
    ("AUBANK", "AU Small Finance Bank"),
    ("BANDHAN", "Bandhan Bank"),
]
HANDLE_DOMAINS = {
    "okaxis": "Axis Bank",
    "okhdfcbank": "HDFC Bank",
    "oksbi": "State Bank of India",
    "okicici": "ICICI Bank",
    "ybl": "PhonePe / Yes Bank",
    "ibl": "IndusInd Bank",
    "axl": "Axis Bank",
    "paytm": "Paytm",
    "apl": "Amazon Pay",
    "jupiteraxis": "Jupiter / Axis",
    "fbl": "Federal Bank",
    "rbl": "RBL Bank",
    "kotak": "Kotak Bank",
    "icici": "ICICI Bank",
    "sbi": "SBI",
    "hdfcbank": "HDFC Bank",
    "indus": "IndusInd Bank",
    "aubank": "AU Small Finance Bank",
    "idfc": "IDFC First Bank",
    "airtel": "Airtel Payments Bank",
}
CHANNEL_WORDS = [
    ("UPI", "UPI"),
    ("NEFT", "NEFT"),
    ("RTGS", "RTGS"),
    ("IMPS", "IMPS"),
    ("ATM", "ATM"),
    ("POS", "POS"),
    ("NACH", "NACH"),
    ("ECS", "ECS"),
    ("ACH", "ACH"),
    ("NET BANKING", "Net Banking"),
    ("NETBANKING", "Net Banking"),
    ("CREDIT CARD", "Credit Card"),
    ("DEBIT CARD", "Debit Card"),
    ("WALLET", "Wallet"),
]
CONFIDENCE = 0.7


def direction_votes(low: str) -> tuple[str, str]:
    def count(words: list[str]) -> str:
        return f"size(filter({array(words)}, w -> contains({low}, w)))"

    return count(DEBIT_WORDS), count(CREDIT_WORDS)


def direction_from_votes(debit: str, credit: str) -> str:
    """Majority of keywords; a tie with any keyword is a debit, no keyword is null."""
    return first_of([(f"{credit} > {debit}", lit("credit")), (f"{debit} > 0", lit("debit"))])


def first_word(text: str, pairs: list[tuple[str, str]]) -> str:
    """Name of the first listed word the text contains."""
    names = ", ".join(f"{lit(word)}, {lit(name)}" for word, name in pairs)
    words = array([word for word, _ in pairs])
    found = f"get(transform(array({text}), t -> get(filter({words}, w -> contains(t, w)), 0)), 0)"
    return f"element_at(map({names}), {found})"


def _fields(text: str, low: str) -> dict[str, str]:
    name = r"[A-Za-z0-9 &._-]{2,40}"
    debit, credit = direction_votes(low)
    votes = f"array(named_struct('debit', {debit}, 'credit', {credit}))"
    vote = f"get(transform({votes}, v -> {direction_from_votes('v.debit', 'v.credit')}), 0)"
    domains = ", ".join(f"{lit(domain)}, {lit(bank)}" for domain, bank in HANDLE_DOMAINS.items())
    domain = first_hit([gated_grab(low, low, ["@"], r"[\w.\-]+@(\w+)", flags="")])
    mark = r"(?:inr|rs\.?|₹)"
    return {
        "fb_amount": first_money(
            [
                gated_grab(text, low, ["inr"], r"INR\s+" + MONEY),
                gated_grab(text, low, ["rs"], r"Rs\.?\s*" + MONEY),
                gated_grab(text, low, ["₹"], r"₹\s*" + MONEY, flags=""),
                gated_grab(
                    text,
                    low,
                    ["has been", "debited", "credited", "deducted"],
                    r"([\d,]+\.\d{2})\s*(?:has been|debited|credited|deducted)",
                ),
            ],
            "v > 0",
        ),
        "fb_direction": vote,
        "fb_account": first_hit(
            [
                gated_grab(
                    low,
                    low,
                    ["a/c", "ac", "card"],
                    r"(?:a/c|acct?|account|card|ac)[\s.#:]*(?:no\.?|number|ending|xx+|\.+)?\s*[x*]*(\d{4})\>",
                    flags="",
                ),
                gated_grab(low, low, ["xx", "..", "*"], r"(?:xx|\.{2,}|\*+)(\d{4})\>", flags=""),
                gated_grab(
                    low, low, ["is credited", "is debited", "has been"],
                    r"\<(\d{4})\s+(?:is credited|is debited|has been)", flags="",
                ),
            ]
        ),
        "fb_balance": first_money(
            [
                gated_grab(
                    text,
                    low,
                    ["bal"],
                    r"(?:avl\.?\s*bal(?:ance)?|available\s+balance|bal(?:ance)?(?:\s+is)?)[:\s]+"
                    + mark + r"?\s*" + MONEY,
                ),
                gated_grab(text, low, ["a/c", "ac"], r"(?:a/c\s+bal|ac\s+balance)[:\s]+" + mark + r"?\s*" + MONEY),
                gated_grab(text, low, ["balance"], r"balance\s+is\s+" + mark + r"\s*" + MONEY),
            ],
            "v IS NOT NULL",
        ),
        "fb_merchant": strip(
            first_hit(
                [
                    gated_grab(text, low, ["@"], rf"(?:to|from)\s+({name})@[a-z]+"),
                    gated_grab(text, low, ["at"], rf"\<at\s+({name})(?:\s+on|\s+for|[,.])"),
                    gated_grab(text, low, ["towards"], rf"towards\s+({name})(?:\s+on|\s+for|[,.])"),
                ]
            )
        ),
        "fb_bank": coalesce([first_word(f"upper({text})", BANK_WORDS), f"element_at(map({domains}), {domain})"]),
        "fb_channel": first_word(f"upper({text})", CHANNEL_WORDS),
        "fb_transfer_ref": "upper("
        + first_hit(
            [
                gated_grab(
                    text,
                    low,
                    ["utr", "neft", "rtgs"],
                    r"(?:utr|neft\s*ref|neft\s*no\.?|rtgs\s*ref)[:\s#]*([A-Z]{4}\d{12,18})",
                ),
                grab(text, r"\<([A-Z]{4}\d{12,18})\>", flags=""),
            ]
        )
        + ")",
        "fb_payment_ref": first_hit(
            [
                gated_grab(
                    text,
                    low,
                    ["ref", "rrn", "transaction"],
                    r"(?:upi\s*ref(?:\s*no\.?)?|rrn|ref\s*no\.?|transaction\s*id)[:\s#]*(\d{12})\>",
                )
            ]
        ),
    }


def with_fallback(routed: DataFrame, condition: str) -> DataFrame:
    """Add the ``fb_*`` fields where the condition holds."""
    return routed.selectExpr(
        "*", *[f"{when(condition, sql)} AS {name}" for name, sql in _fields("_text", "_low").items()]
    )


def reference_type() -> str:
    return first_of(
        [("fb_transfer_ref IS NOT NULL", lit("neft_utr")), ("fb_payment_ref IS NOT NULL", lit("upi_rrn"))]
    )


def fallback_parse(unmatched: DataFrame) -> DataFrame:
    """Best-effort fields (``fb_*``) for every given message."""
    from tallymill.operators.filters import with_text

    parsed = with_fallback(with_text(unmatched), "true")
    return parsed.selectExpr(
        "*", "coalesce(fb_transfer_ref, fb_payment_ref) AS fb_ref_number", f"{reference_type()} AS fb_ref_type"
    ).drop("_text", "_low", "fb_transfer_ref", "fb_payment_ref")
