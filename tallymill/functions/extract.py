"""Field extractors over message text.

An extractor is an ordered list of captures in one array expression: each pattern is written once, stands
behind a substring test, and the first hit is taken. Array functions also keep these projections out of
whole-stage code, whose single method would grow past what the JVM compiles.
"""

from __future__ import annotations

from tallymill.functions.marks import Marks, ask, linear, phrases, spaced
from tallymill.functions.text import (
    BLANKS,
    MONEY,
    any_of,
    array,
    both,
    coalesce,
    either,
    first_hit,
    first_money,
    first_of,
    gated_grab,
    grab,
    has,
    lit,
    strip,
    when,
)

# Bank tokens looked up in text with blanks and -_/. removed; first one contained wins.
BANK_TOKENS = [
    ("punjabnationalbank", "Punjab National Bank"),
    ("statebankofindia", "State Bank of India"),
    ("bankofmaharashtra", "Bank of Maharashtra"),
    ("bankofbaroda", "Bank of Baroda"),
    ("bankofindore", "Bank of Indore"),
    ("centralbankofindia", "Central Bank of India"),
    ("indianoverseasbank", "Indian Overseas Bank"),
    ("tamilnadmercantilebank", "Tamilnad Mercantile Bank"),
    ("karurvysyabank", "Karur Vysya Bank"),
    ("cityunionbank", "City Union Bank"),
    ("southindianbank", "South Indian Bank"),
    ("lakshmivilasbank", "Lakshmi Vilas Bank"),
    ("dhanlaxmibank", "Dhanlaxmi Bank"),
    ("airtelpaymentbank", "Airtel Payments Bank"),
    ("paytmpaymentbank", "Paytm Payments Bank"),
    ("jiopaymentbank", "Jio Payments Bank"),
    ("finopaymentbank", "Fino Payments Bank"),
    ("nsdlpaymentbank", "NSDL Payments Bank"),
    ("ausmallfinancebank", "AU Small Finance Bank"),
    ("equitasbank", "Equitas Small Finance Bank"),
    ("ujjivanbank", "Ujjivan Small Finance Bank"),
    ("esafbank", "ESAF Small Finance Bank"),
    ("suryodaybank", "Suryoday Small Finance Bank"),
    ("idfcfirstbank", "IDFC First Bank"),
    ("kotakbank", "Kotak Mahindra Bank"),
    ("kotakmahindra", "Kotak Mahindra Bank"),
    ("indusindbank", "IndusInd Bank"),
    ("federalbank", "Federal Bank"),
    ("saraswatbank", "Saraswat Bank"),
    ("karnatkabank", "Karnataka Bank"),
    ("nainitalbank", "Nainital Bank"),
    ("hdfcbank", "HDFC Bank"),
    ("icicibank", "ICICI Bank"),
    ("axisbank", "Axis Bank"),
    ("yesbank", "Yes Bank"),
    ("rblbank", "RBL Bank"),
    ("dcbbank", "DCB Bank"),
    ("canarabank", "Canara Bank"),
    ("unionbank", "Union Bank of India"),
    ("indianbank", "Indian Bank"),
    ("hdfcbk", "HDFC Bank"),
    ("icicibk", "ICICI Bank"),
    ("indusind", "IndusInd Bank"),
    ("utibbank", "Axis Bank"),
    ("aubank", "AU Small Finance Bank"),
    ("idfc", "IDFC First Bank"),
    ("sbi", "State Bank of India"),
    ("pnb", "Punjab National Bank"),
    ("bob", "Bank of Baroda"),
    ("iob", "Indian Overseas Bank"),
    ("kvb", "Karur Vysya Bank"),
    ("tmb", "Tamilnad Mercantile Bank"),
    ("cub", "City Union Bank"),
    ("sib", "South Indian Bank"),
]

# Foreign currency codes, months, channel patterns, handle brands.
CURRENCY_CODES = ["USD", "GBP", "EUR", "SGD", "AED", "JPY", "AUD", "CAD"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
UPI_MANDATE = r"^UPI Mandate:"
MANDATE = r"\<NACH\>|\<UMRN\>|\<mandate\>|\<standing instruction\>|\<ECS\>|\<auto.?pay\>"
CARD_SPEND_CHANNEL = (
    r"(?:Txn\s+Rs\.|Spent\s+Rs\.)\s*[\d,]+.*On\s+"
    r"(?:HDFC|ICICI|SBI|Axis|Kotak|Yes|IndusInd|RBL|IDFC|Federal)\s+Bank\s+Card"
)
# Each with substrings of which every hit has one.
CHANNELS = [
    (MANDATE, "i", ["nach", "umrn", "mandate", "standing", "ecs", "auto"], "NACH"),
    (r"\<ATM\>|cash withdrawal|Withdrawn", "i", ["atm", "withdraw"], "ATM"),
    (CARD_SPEND_CHANNEL, "is", ["spent", "txn"], "Credit Card"),
    (r"credit card|debit card|Card x\d|Card \d{4}|Spent\>", "i", ["card", "spent"], "Card"),
    (r"\<NEFT\>|\<RTGS\>|\<IMPS\>|\<UTR\>", "i", ["neft", "rtgs", "imps", "utr"], "NEFT"),
    (r"net\s*banking|online\s+banking|internet\s+banking", "i", ["banking"], "Net Banking"),
    (r"\<IB\s+(?:SS\s+)?FUNDS\s+TRANSFER\>", "i", ["funds"], "IMPS"),
    (r"\<CHQ\s+DEP\>|\<CTS\s+CLG\>|\<cheque\s+deposit\>", "i", ["chq", "cts", "cheque"], "Cheque"),
    (r"\<UPI\>|VPA|UPI Ref|RRN|@[a-z]+\>", "i", ["upi", "vpa", "rrn", "@"], "UPI"),
    (r"wallet", "i", ["wallet"], "Wallet"),
    (r"\<EMI\>", "i", ["emi"], "EMI"),
]
DEFAULT_CHANNEL = "UPI"
HANDLE_BRANDS = [
    "irctc", "flipkart", "amazon", "swiggy", "zomato", "zepto", "blinkit", "bigbasket", "myntra", "ajio",
    "netflix", "hotstar", "jiocinema", "sonyliv", "paytm", "phonepe", "gpay", "airtel", "jio", "bsnl",
    "tangedco", "bescom", "bookmyshow", "pvr", "inox", "google", "microsoft", "anthropic", "cleartax",
    "zerodha", "groww", "upstox", "shriramlife", "lic", "hdfcbank", "icicibank", "sbi", "axisbank", "kotak",
    "hdfc", "irctc.payu", "bbmps",
]
SELF_TRANSFER = [
    (r"ib\s+(?:ss\s+)?funds\s+transfer", ["funds"]),
    (r"\<ppf\>|\<ssy\>|\<nps\>", ["ppf", "ssy", "nps"]),
    (r"\<rd\s+a/c\>|\<fd\s+a/c\>", ["rd", "fd"]),
    (r"\<credit\s+card\s+(?:bill|payment|due)\>", ["credit"]),
]
SELF_TRANSFER_WORDS = ["zerodha", "groww", "upstox", "indmoney", "kuvera"]
FUNDS_TRANSFER_LABEL = r"^IB\s+(SS\s+)?FUNDS\s+TRANSFER"
CARD_ENDING_LABEL = r"your\s+(credit\s+)?card\s+ending"
HANDLE_TEXT = r"\S+@\S+"

# Patterns of figures, accounts, balances, references and merchants, in the order in which they are tried.
AMOUNT_INR, AMOUNT_RS, AMOUNT_SIGN = r"INR\s+" + MONEY, r"Rs\.?\s*" + MONEY, r"₹\s*" + MONEY
AMOUNT_FOREIGN = r"\<(?:" + "|".join(CURRENCY_CODES) + r")\s+" + MONEY
AMOUNT_OF = r"transaction of\s+" + MONEY
ACCOUNT_ENDING = r"(?:account|card)\s+ending\s+(?:with\s+)?[Xx*]{0,4}(\d{4})\>"
ACCOUNT_MASKED = r"[Xx*]{1,2}(\d{4})\>"
ACCOUNT_SHORT = r"A/[Cc](?:\s*No\.?)?\s*[Xx*]{0,2}(\d{4})\>"
ACCOUNT_PLAIN = r"(?:account|card)\s+[X*]{0,4}(\d{4})\>"
BALANCE_AVL = r"Avl\.?\s*Bal\.?[:\s]+(?:INR|Rs\.?)\s*" + MONEY
BALANCE_AVAILABLE = r"Available\s+Balance\.?\s*(?:Rs\.?|INR)?\s*" + MONEY
BALANCE_IS = r"Balance\s+is\s+(?:Rs\.?|INR)\s*" + MONEY
BALANCE_SHORT = r"\<Bal[:\s]+(?:Rs\.?|INR)?\s*" + MONEY
REFERENCE_UPI = r"UPI[:\s]+(\d{12})\>"
REFERENCE_REF = r"Ref(?:\s*No\.?|erence)?\s*[:# ]?\s*(\d{12})\>"
REFERENCE_RRN = r"RRN[:\s]+(\d{12})\>"
REFERENCE_LONG = r"\<Ref\s+(\d{12,})\>"
REFERENCE_TRANSFER = r"(?:UTR|UMRN)[:\s]+([A-Z]{2,6}\d{10,18})\>"
MERCHANT_TO = r"\<To\s+(.{3,40}?)(?:\s*\n|\s+On\s|\s+Ref\s|\s+via\s|\s+successful\>|\s+from\s+A/c)"
MERCHANT_AT = r"\<At\s+(.{3,40}?)\s+On\s"
MERCHANT_TOWARDS = r"\<towards\s+(.{3,50}?)(?:\s+UMRN|\s+Ref|\s+Mandate|\.)"
MERCHANT_FROM = r"transfer from\s+([A-Z][A-Z ]{2,40}?)\s+Ref"
MERCHANT_VPA = r"from VPA\s+([\w.\-@]+)"
MERCHANT_INFO = r"Info:\s+(.{3,60}?)(?:\.\s*Avl|\z)"
REVERSED = r"\<has been reversed\>|\<has been refunded\>|\<reversal of\>"
DATE_ISO, DATE_SLASH, DATE_SHORT = r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{2}[-/]\d{2}[-/]\d{2}\>"
DATE_NAMED_LONG, DATE_NAMED = r"\d{1,2}[-\s]?[A-Za-z]{3}[-\s]?\d{4}\>", r"\d{1,2}[-\s]?[A-Za-z]{3}[-\s]?\d{2}\>"

#: Signs that are left out before a bank token is looked up.
BANK_BETWEEN = BLANKS + "-_/."
#: What a text must hold for a field to be found in it; see ``functions/marks``.
FAMILIES = {
    "bank": spaced([token for token, _ in BANK_TOKENS], BANK_BETWEEN),
    "channel": phrases(["upi mandate:", *(anchor for _, _, anchors, _ in CHANNELS for anchor in anchors)]),
    "self_transfer": phrases([anchor for _, anchors in SELF_TRANSFER for anchor in anchors] + SELF_TRANSFER_WORDS),
    **{p: linear(p) for p in (DATE_ISO, DATE_SLASH, DATE_SHORT, DATE_NAMED_LONG, DATE_NAMED)},
}


def amount(text: str, low: str) -> str:
    """First positive figure among the currency forms, in their order of trust."""
    return first_money(
        [
            gated_grab(text, low, ["inr"], AMOUNT_INR),
            gated_grab(text, low, ["rs"], AMOUNT_RS),
            gated_grab(text, low, ["₹"], AMOUNT_SIGN, flags=""),
            gated_grab(text, low, [c.lower() for c in CURRENCY_CODES], AMOUNT_FOREIGN),
            gated_grab(text, low, ["transaction of"], AMOUNT_OF),
        ],
        "v > 0",
    )


def date_text(text: str, low: str, marks: Marks | None = None) -> str:
    """First date found, as ``YYYY-MM-DD`` text; it may name a day that does not exist."""
    def found(pattern: str, anchors: list[str]) -> str:
        if marks is None and anchors:
            return gated_grab(text, low, anchors, pattern, 0, "")
        return when(ask(marks, pattern, "true"), grab(text, pattern, 0, ""), "''")

    slash, short = found(DATE_SLASH, ["/"]), found(DATE_SHORT, ["-", "/"])
    numeric = [
        found(DATE_ISO, ["-"]),
        f"regexp_replace({slash}, '^(..).(..).(....)$', '$3-$2-$1')",
        f"regexp_replace({short}, '^(..).(..).(..)$', '20$3-$2-$1')",
    ]
    named = [found(DATE_NAMED_LONG, []), found(DATE_NAMED, [])]
    month = f"array_position({array(MONTHS)}, lower(regexp_extract(d, '[A-Za-z]+', 0)))"
    year = "right(concat('20', regexp_extract(d, '[0-9]+$', 0)), 4)"
    day = "lpad(regexp_extract(d, '^[0-9]+', 0), 2, '0')"
    iso = f"CASE WHEN {month} > 0 THEN concat({year}, '-', lpad({month}, 2, '0'), '-', {day}) END"
    # a form is looked for only where those before it have found nothing
    names = [f"get(transform(filter(array({capture}), d -> d <> ''), d -> {iso}), 0)" for capture in named]
    return coalesce([*(first_hit([capture]) for capture in numeric), *names])


def account(text: str, low: str) -> str:
    """Last four digits of the account or card."""
    return first_hit(
        [
            gated_grab(text, low, ["ending"], ACCOUNT_ENDING),
            gated_grab(text, low, ["x", "*"], ACCOUNT_MASKED, flags=""),
            gated_grab(text, low, ["a/c"], ACCOUNT_SHORT, flags=""),
            gated_grab(text, low, ["account", "card"], ACCOUNT_PLAIN),
        ]
    )


def bank(low: str, marks: Marks | None = None) -> str:
    """First bank token contained in the squeezed text, translated to its name.

    Handles are removed before squeezing, so that the bank of a counterparty's handle is not taken.
    """
    bare = when(f"contains({low}, '@')", f"regexp_replace({low}, {lit(HANDLE_TEXT)}, ' ')", low)
    squeezed = f"translate({bare}, {lit(BANK_BETWEEN)}, '')"
    tokens = array([token for token, _ in BANK_TOKENS])
    names = ", ".join(f"{lit(token)}, {lit(name)}" for token, name in BANK_TOKENS)
    # the outer transform binds the squeezed text once
    found = f"get(transform(array({squeezed}), s -> get(filter({tokens}, t -> contains(s, t)), 0)), 0)"
    name = f"element_at(map({names}), {found})"
    # a handle that is taken out leaves a blank, so its neighbours can meet as well
    return name if marks is None else when(either([ask(marks, "bank", "true"), f"contains({low}, '@')"]), name)


def channel(text: str, low: str | None = None, marks: Marks | None = None) -> str:
    low = low or f"lower({text})"
    tests = [(both([any_of(low, ["upi mandate:"]), has(text, UPI_MANDATE, "im")]), lit("UPI"))]
    tests += [(both([any_of(low, anchors), has(text, pattern, flags)]), lit(name)) for pattern, flags, anchors, name in CHANNELS]
    if marks is not None:
        tests.insert(0, (f"NOT {ask(marks, 'channel', 'true')}", lit(DEFAULT_CHANNEL)))
    return first_of(tests, lit(DEFAULT_CHANNEL))


def balance(text: str, low: str) -> str:
    """First balance figure; zero counts."""
    return first_money(
        [
            gated_grab(text, low, ["avl"], BALANCE_AVL),
            gated_grab(text, low, ["available"], BALANCE_AVAILABLE),
            gated_grab(text, low, ["balance"], BALANCE_IS),
            gated_grab(text, low, ["bal"], BALANCE_SHORT),
        ],
        "v IS NOT NULL",
    )


def payment_reference(text: str, low: str) -> str:
    """Twelve-digit payment reference."""
    return first_hit(
        [
            gated_grab(text, low, ["upi"], REFERENCE_UPI),
            gated_grab(text, low, ["ref"], REFERENCE_REF),
            gated_grab(text, low, ["rrn"], REFERENCE_RRN),
            gated_grab(text, low, ["ref"], REFERENCE_LONG),
        ]
    )


def transfer_reference(text: str, low: str) -> str:
    """Bank transfer or mandate reference."""
    return first_hit([gated_grab(text, low, ["utr", "umrn"], REFERENCE_TRANSFER)])


def handle(text: str, low: str) -> str:
    return first_hit([gated_grab(text, low, ["from vpa"], MERCHANT_VPA)])


def merchant(text: str, low: str) -> str:
    """First merchant clause, trimmed; '' or null for none.

    A clause that turns out to be a label is replaced by a blank: it still ends the search.
    """
    def guarded(capture: str, label: str) -> str:
        return f"get(transform(array({capture}), m -> {when(has(strip('m'), label), lit(' '), 'm')}), 0)"

    clauses = [
        guarded(
            gated_grab(
                text, low, ["to"],
                MERCHANT_TO,
            ),
            FUNDS_TRANSFER_LABEL,
        ),
        gated_grab(text, low, ["at"], MERCHANT_AT),
        guarded(
            gated_grab(text, low, ["towards"], MERCHANT_TOWARDS),
            CARD_ENDING_LABEL,
        ),
        gated_grab(text, low, ["transfer from"], MERCHANT_FROM),
        gated_grab(text, low, ["from vpa"], MERCHANT_VPA),
        guarded(gated_grab(text, low, ["info:"], MERCHANT_INFO), FUNDS_TRANSFER_LABEL),
    ]
    reversed_text = both([any_of(low, ["revers", "refunded"]), has(low, REVERSED, "")])
    return when(reversed_text, "''", strip(first_hit(clauses)))


def handle_class(handle_column: str) -> str:
    """``person``, ``merchant`` or ``unknown`` for a payment handle; null for no handle."""
    name = f"lower(substring_index({handle_column}, '@', 1))"
    digits, letters = has(name, r"\d{4,}", ""), has(name, r"[a-z]{3,}", "")
    return first_of(
        [
            (f"{handle_column} IS NULL", "NULL"),
            (has(name, r"^\d+\z", ""), lit("person")),
            (any_of(name, HANDLE_BRANDS), lit("merchant")),
            (both([letters, digits]), lit("person")),
            (has(name, r"^[a-z]+(?:[.\-_][a-z]+)*\d*\z", ""), lit("person")),
        ],
        lit("unknown"),
    )


def is_self_transfer(low: str, marks: Marks | None = None) -> str:
    tests = [both([any_of(low, anchors), has(low, pattern, "")]) for pattern, anchors in SELF_TRANSFER]
    return ask(marks, "self_transfer", either([*tests, any_of(low, SELF_TRANSFER_WORDS)]))


def merchant_key(merchant_text: str) -> str:
    key = f"substring(regexp_replace(lower({merchant_text}), '[^a-z0-9@]', ''), 1, 40)"
    return f"nullif({key}, '')"
