"""Ordered message rules as data, and the job that routes a message table through them.

A rule is a set of text tests plus the places its fields come from. ``route_messages`` turns a rule list
into a few wide projections: the number of the first matching rule, the fields that rule takes from the
text, then what follows from the fields. A user adds a rule by putting a ``Rule`` into the list.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tallymill.functions import extract as X
from tallymill.functions.marks import Marks, ask, phrases, with_marks
from tallymill.functions.text import (
    MONEY,
    any_of,
    array,
    both,
    coalesce,
    either,
    first_hit,
    first_of,
    grab,
    has,
    lit,
    select_sealed,
    strip,
    when,
)


@dataclass(frozen=True)
class Test:
    """A pattern and the substrings it implies; ``"a|b"`` means one of the two must be present. The rarest come last."""

    __test__ = False  # not a test case

    pattern: str
    anchors: tuple[str, ...] = ()
    flags: str = "i"

    def sql(self, text: str, low: str) -> str:
        gates = [any_of(low, anchor.split("|")) for anchor in self.anchors]
        return both([*gates, has(text, self.pattern, self.flags)])


@dataclass(frozen=True)
class Rule:
    """One message template family. Empty own patterns mean: use the generic extractor.

    ``direction`` and ``channel`` are constants, or functions from the text column name to SQL text.
    """

    id: str
    tests: tuple[Test, ...]
    unless: tuple[Test, ...] = ()
    discard: str | None = None
    direction: str | Callable[[str], str] | None = None
    channel: str | Callable[[str], str] | None = None
    confidence: float | None = None
    contra: bool | str = False
    bank: bool = True
    balance: bool = True
    amount: tuple[str, ...] = ()
    account: tuple[str, ...] = ()
    account_generic: bool = True
    partial_date: str | None = None
    merchant: tuple[tuple[str, str], ...] = ()
    merchant_generic: bool = False
    merchant_constant: str | None = None
    merchant_format: str | None = None
    merchant_alias: tuple[str, str] | None = None
    merchant_null_if: tuple[str, ...] = ()
    handle: bool = False
    review_without_merchant: bool = False
    reference: tuple[str, str] | None = None
    reference_generic: bool = True


def generic_channel(text: str, marks: Marks | None = None) -> str:
    return X.channel(text, "_low", marks)


# The rule list, in order. First match wins.
LEGACY_DIRECTION = r"\<AC\s+[Xx*]{1,4}\d{4}\s+(DR|CR)\s+RS\.?\s*\d"
RULES: list[Rule] = [
    Rule(
        "GENERIC_DECLINED",
        (
            Test(r"\<no\s+(?:money|amount)\s+(?:has\s+been\s+)?(?:deducted|debited)\>", ("deducted|debited", "money|amount")),
            Test(r"\<amount\s+not\s+debited\>|\<not\s+been\s+debited\>", ("debited", "not")),
            Test(
                r"declined|txn.*fail|transaction.*fail|payment.*fail|could\s+not\s+be\s+processed",
                ("declined|fail|processed",),
            ),
        ),
        unless=(Test(r"\<reversed\>|\<reversal\s+of\>", ("revers",)),),
        discard="declined_transaction",
    ),
    Rule(
        "GENERIC_CC_EMI_CONVERSION",
        (Test(r"credit\s*card.*purchase\s+of.*converted\s+to.*month\s+emi", ("purchase", "converted")),),
        discard="cc_emi_conversion_not_new_txn",
    ),
    Rule(
        "BALANCE_ALERT_ONLY",
        (
            Test(r"\<balance\s+is\s+low\>", ("balance",)),
            Test(r"\<bal\s+is\>.{0,20}\<below\>", ("below",)),
            Test(r"\<available\s+bal(?:ance)?\>.{0,80}\<is\>", ("available",)),
            Test(r"\<minimum\s+balance\>", ("minimum",)),
        ),
        unless=(
            Test(
                r"\<debited\>|\<credited\>|\<deducted\>|\<withdrawn\>|\<withdrawal\>|\<spent\>|\<paid\>"
                r"|\<transferred\>|\<received\>|\<refunded\>|\<disbursed\>|\<NEFT\>|\<IMPS\>|\<RTGS\>|\<UPI\>|\<EMI\>"
            ),
        ),
        discard="balance_disclosure_no_transaction",
    ),
    Rule(
        "GENERIC_CC_SPEND_TXN",
        (
            Test(r"Txn\s+Rs\.[\d,]+.*On\s+\w[\w\s]+Bank\s+Card\s+\d{4}", ("txn", "bank", "card"), "is"),
            Test(r"Spent\s+Rs\.[\d,]+\s+On\s+\w[\w\s]+Bank\s+Card\s+\d{4}", ("spent", "bank", "card")),
            Test(
                r"Paid\s+(?:USD|GBP|EUR|SGD|AED|JPY|AUD|CAD)\s*[\d,.]+.*On\s+\w[\w\s]+Bank\s+Card\s+\d{4}",
                ("paid", "bank", "card"),
                "is",
            ),
        ),
        direction="debit",
        channel="Credit Card",
        confidence=0.88,
        balance=False,
        amount=(r"(?:Txn|Spent)\s+Rs\." + MONEY, r"Paid\s+(?:USD|GBP|EUR|SGD|AED|JPY|AUD|CAD)\s*" + MONEY),
        account=(r"Card\s+(\d{4})\>",),
        partial_date=r"\<On\s+\d{1,2}-\d{2}\>",
        merchant=((r"\<At\s+(.{2,40}?)(?:\s*\n|\s+by\s+UPI|\s+On\s+\d|\s+Not\s+You)", "i"),),
        merchant_null_if=(r"^q\d{9}[a-z0-9.]*@[a-z]+\z",),
        reference=(r"by\s+UPI\s+(\d{12})\>", "upi_rrn"),
        reference_generic=False,
    ),
    Rule(
        "GENERIC_CC_PAYMENT",
        (
            Test(
                r"for:\s*credit card payment|paid towards.*credit card|payment towards.*credit card"
                r"|paid.*for.*credit card|received\s+towards.*credit\s+card"
                r"|payment\s+of\s+.*received\s+towards.*credit\s+card"
                r"|(?:credited|received|paid).{0,40}credit\s*card.{0,30}bill\s*payment",
                ("credit", "card"),
            ),
        ),
        direction="debit",
        channel="Net Banking",
        confidence=0.90,
        contra=True,
        balance=False,
        amount=(r"(?:Paid|Payment\s+of)\s+(?:Rs\.?|INR)\s*" + MONEY,),
    ),
    Rule(
        "PLUXEE_SPEND",
        (
            Test(
                r"Rs\.?\s*[\d,]+(?:\.\d{1,2})?\s+spent\s+from\s+\w+\s+(?:Meal\s+Card|Gift\s+Card|Food\s+Card|Wallet)",
                ("from", "spent"),
            ),
        ),
        direction="debit",
        channel=lambda text: when(
            has(text, r"card\s+(?:no\.?\s*[x*]{0,4}\d{4}|ending\s+\d{4})|prepaid\s+card"), "'Card'", "'Wallet'"
        ),
        confidence=0.88,
        bank=False,
        amount=(r"Rs\.?\s*" + MONEY + r"\s+spent\s+from",),
        account=(r"card\s+no\.?\s*[xX*]{0,4}(\d{4})\>",),
        account_generic=False,
        merchant=(
            (r"\<at\s+(.{2,50}?)\.\s*Avl\s+Bal", "i"),
            (r"\<at\s+([A-Z][A-Z0-9\s&._-]{1,50}?)(?:\s*\.|$)", "im"),
        ),
        review_without_merchant=True,
        reference_generic=False,
    ),
    Rule(
        "PLUXEE_CREDIT",
        (
            Test(
                r"successfully\s+credited\s+with\s+Rs\.?\s*[\d,]+.*(?:Meal\s+Wallet|Gift\s+Wallet|Food\s+Wallet|Wallet)",
                ("successfully", "wallet"),
            ),
        ),
        direction="credit",
        channel="Wallet",
        confidence=0.88,
        contra=True,
        bank=False,
        amount=(r"credited\s+with\s+Rs\.?\s*" + MONEY,),
        account_generic=False,
        reference_generic=False,
    ),
    Rule(
        "NCMC_LOAD",
        (Test(r"(?:NCMC|Prepaid\s+Card).*is\s+loaded\s+with\s+Rs\.?\s*[\d,]+", ("loaded",)),),
        direction="debit",
        channel="Card",
        confidence=0.88,
        contra=True,
        amount=(r"loaded\s+with\s+Rs\.?\s*" + MONEY,),
        account=(r"\d{6}[X*]+(\d{4})",),
        reference_generic=False,
    ),
    Rule(
        "GENERIC_WALLET_SPEND",
        (
            Test(r"paid\s+to\s+.+?\s+from\s+your\s+.{0,30}?(?:wallet|balance)", ("paid", "from", "wallet|balance")),
            Test(r"amazon\s+pay.*(?:using|from).*(?:balance|wallet)", ("amazon",)),
            Test(r"using\s+apay\s+balance|apay\s+balance.*successful", ("apay",)),
            Test(r"paytm.*wallet.*(?:debited|used)|phonepe.*wallet.*(?:debited|used)", ("paytm|phonepe", "wallet")),
            Test(r"wallet\s+balance.*(?:debited|used|spent)", ("wallet", "balance")),
        ),
        direction="debit",
        channel="Wallet",
        confidence=0.85,
        bank=False,
        merchant=(
            (r"paid\s+to\s+(.{2,40}?)\s+from\s+your\>", "i"),
            (r"\<at\s+(.{2,40}?)(?:\s*\n|\s+on\s+\d|\s+not\s+you|\z)", "i"),
        ),
        merchant_generic=True,
        merchant_alias=("a.in", "Amazon.in"),
    ),
    Rule(
        "GENERIC_NETBANKING_PAYMENT",
        (
            Test(r"payment\s+successful!", ("successful!",)),
            Test(r"payment\s+of\s+Rs\..*(?:is|was)\s+successful", ("payment", "successful")),
            Test(r"Rs\..*from\s+A/c.*via.*(?:net\s*banking|online\s+banking)", ("a/c", "banking")),
        ),
        direction="debit",
        channel="Net Banking",
        confidence=0.85,
        merchant=((r"\<to\s+(.{3,50}?)\s+via\s+", "i"),),
    ),
    Rule(
        "GENERIC_NACH",
        (Test(X.MANDATE, ("nach|umrn|mandate|standing|ecs|auto",)),),
        unless=(Test(X.UPI_MANDATE, ("mandate",), "im"),),
        channel="NACH",
        confidence=0.85,
        merchant_generic=True,
    ),
    Rule(
        "GENERIC_PPF_SSY",
        (
            Test(
                r"transferred to your PPF|transferred to your SSY|PPF/SSY A/c|Sukanya.*transfer"
                r"|Public Provident.*transfer",
                ("ppf|ssy|sukanya|provident",),
            ),
        ),
        channel="NEFT",
        confidence=0.92,
        contra=True,
        merchant_constant="PPF / SSY Account",
    ),
    Rule(
        "LOAN_DISBURSEMENT",
        (
            Test(
                r"\<loan\s+amount\>.*\<disbursed\>|\<loan\s+amount\>.*\<credited\>|\<loan\s+disburs(?:ed|al)\>"
                r"|\<loan\s+of\s+Rs\.?.*\<disbursed\>|\<\w+\s+loan\>[^.\n\r]{0,60}\<disbursed\>",
                ("disburs|credited", "loan"),
            ),
        ),
        direction="credit",
        channel=generic_channel,
        confidence=0.9,
        merchant_constant="Loan Disbursement",
    ),
    Rule(
        "CHEQUE_CLEARED_DEBIT",
        (Test(r"cheque\s+no[.\s]+\d+.*\<cleared\>.*\<from\s+A/c", ("cheque", "cleared")),),
        direction="debit",
        channel="Cheque",
        confidence=0.85,
        merchant=((r"cheque\s+no[.\s]+(\d+)", "i"),),
        merchant_format="Cheque #%s",
        reference=(r"cheque\s+no[.\s]+(\d+)", "cheque_number"),
        reference_generic=False,
    ),
    Rule(
        "CARD_POS_USED_FOR",
        (
            Test(r"\<card\>.{0,20}\<used\s+for\>", ("card", "used")),
            Test(r"\<using\>.{0,20}\<card\>.{0,20}\<for\s+Rs", ("using", "card")),
        ),
        direction="debit",
        channel="Card",
        confidence=0.85,
        merchant=((r"\<at\s+(.{2,40}?)(?:\s+on\s+\d|\s*\.|\s*\z)", "i"),),
    ),
    Rule(
        "GENERIC_CHARGED",
        (Test(r"\<charged\s+(?:to|for)\>", ("charged",)),),
        direction="debit",
        channel=generic_channel,
        confidence=0.82,
        merchant=((r"charged\s+for\s+your\s+(.{2,40}?)(?:\s+on\s+\d|\.|\z)", "i"),),
        merchant_generic=True,
    ),
    Rule(
        "CASH_DEPOSIT",
        (Test(r"\<cash\s+deposit\s+of\>", ("deposit",)),),
        direction="credit",
        channel=lambda text: when(has(text, r"\<ATM\>|\<CDM\>"), "'ATM'", "'Cash'"),
        confidence=0.85,
        contra=True,
        merchant_constant="Cash Deposit",
    ),
    Rule(
        "WALLET_LOAD",
        (Test(r"\<added\s+to\s+your\>.*\<from\s+linked\s+bank\s+account\>", ("added", "linked")),),
        direction="credit",
        channel="Wallet",
        confidence=0.85,
        contra=True,
        merchant=(
            (r"added\s+to\s+your\s+(.{2,30}?)\s+(?:wallet|balance)", "i"),
            (r"added\s+to\s+your\s+(.{2,30}?)\s+on\s+\d", "i"),
        ),
        merchant_format="%s Wallet Load",
        merchant_constant="Wallet Load",
    ),
    Rule(
        "GENERIC_PAID_TO",
        (
            Test(
                r"\<paid\>.{0,25}?\<(?:to|towards|for|at)\>|\<has\s+been\s+paid\s+successfully\>",
                ("paid",),
            ),
        ),
        direction="debit",
        channel=generic_channel,
        confidence=0.82,
        contra="self_transfer",
        merchant=(
            (r"\<to\s+([A-Za-z][A-Za-z .]{2,40}?)\s+(?:using|from|on|via)\>", "i"),
            (r"\<paid\s+for\s+(.{2,40}?)\s+(?:renewal|membership|on\s+\d)", "i"),
            (r"\<paid\s+at\s+(.{2,40}?)\s+(?:via|on\s+\d)", "i"),
            (r"\<parking\s+at\s+(.{2,40}?)\s+via\>", "i"),
            (r"^Your\s+(.{2,30}?)\s+(?:electricity|gas|water|mobile|broadband)?\s*bill\>", "i"),
        ),
        reference=(r"UPI\s+transaction\s+ID\s*[:\s]*(\d{8,})", "upi_rrn"),
    ),
    Rule(
        "GENERIC_PURCHASE_CONFIRMATION",
        (
            Test(r"paid\s+via\s+\w+.*for|:\s*Rs\.?[\d,]+(?:\.\d{1,2})?\s+paid\s+for", ("paid",)),
            Test(
                r"payment\s+of\s+(?:Rs\.?|INR)\s*[\d,]+(?:\.\d{1,2})?\s+successful\s+for",
                ("payment", "successful"),
            ),
            Test(
                r"recharge\s+of\s+(?:Rs\.?|INR)\s*[\d,]+(?:\.\d{1,2})?\s+(?:is\s+|was\s+)?successful",
                ("recharge", "successful"),
            ),
            Test(r"gift\s+card\s+purchased\s+successfully", ("purchased",)),
            Test(r"recharged\s+with\s+(?:Rs\.?|INR)\s*[\d,]+", ("recharged",)),
            Test(
                r"(?:gold|purchase)\s+(?:purchase\s+)?of\s+[\d.]+\s*g(?:rams?)?\s+worth\s+(?:Rs\.?|INR)\s*[\d,]+.*successful",
                ("worth", "successful"),
            ),
        ),
        direction="debit",
        channel=generic_channel,
        confidence=0.75,
        bank=False,
        balance=False,
        merchant=(
            (r"^([A-Za-z][A-Za-z0-9 ]{2,30}?):", ""),
            (r"paid\s+via\s+(\w+)", "i"),
            (r"for\s+your\s+(\w+)\s+order", "i"),
            (r"^(\w+)\s+(?:DTH|Mobile)\s+Recharge", "i"),
            (r"Rs\.?[\d,]+(?:\.\d{1,2})?\s+([A-Za-z][A-Za-z0-9 ]{2,30}?)\s+Gift\s+Card", "i"),
            (r"^([A-Za-z][A-Za-z0-9 ]{2,30}?)\s+Smart\s+Card\s+recharged", "i"),
            (r"\<via\s+([A-Za-z][A-Za-z0-9 ]{2,30}?)\s+on\s+\d", "i"),
        ),
        reference_generic=False,
    ),
    Rule(
        "DEMAND_DRAFT_ISSUED",
        (Test(r"demand\s+draft\s+no[.\s]+\d+.*\<issued\s+against\>", ("demand", "issued")),),
        direction="debit",
        channel="DD",
        confidence=0.85,
        balance=False,
        merchant=((r"demand\s+draft\s+no[.\s]+(\d+)", "i"),),
        merchant_format="Demand Draft #%s",
        reference=(r"demand\s+draft\s+no[.\s]+(\d+)", "dd_number"),
        reference_generic=False,
    ),
    Rule(
        "LEGACY_DR_CR_FORMAT",
        (Test(r"\<AC\s+[Xx*]{1,4}\d{4}\s+(?:DR|CR)\s+RS\.?\s*\d", ("rs", "ac")),),
        direction=lambda text: when(
            f"upper({grab(text, LEGACY_DIRECTION)}) = 'CR'", "'credit'", "'debit'"
        ),
        channel="UPI",
        confidence=0.8,
        reference_generic=False,
    ),
    Rule(
        "COURIER_COD_PAYMENT",
        (Test(r"\<collected\s+as\s+COD\s+payment\>", ("collected",)),),
        direction="debit",
        channel="Cash",
        confidence=0.7,
        bank=False,
        balance=False,
        account_generic=False,
        merchant=((r"^([A-Za-z][A-Za-z0-9 ]{2,20}?):", ""),),
        reference_generic=False,
    ),
    Rule(
        "REFUND_INITIATED",
        (Test(r"refund\s+of\s+(?:Rs\.?|INR)\s*[\d,]+(?:\.\d{1,2})?.*initiated", ("refund", "initiated")),),
        direction="credit",
        channel="Refund",
        confidence=0.6,
        balance=False,
        merchant=((r"returned\s+(.{2,30}?)\s+order", "i"),),
        reference_generic=False,
    ),
    Rule(
        "GENERIC_DEBIT",
        (
            Test(
                r"\<debited\>|\<deducted\>|\<Sent\>|\<Withdrawn\>|\<Withdrawal\>|\<Wdl\>|\<Spent\>",
                ("debited|deducted|sent|withdraw|wdl|spent",),
            ),
        ),
        channel=generic_channel,
        confidence=0.80,
        contra="self_transfer",
        merchant_generic=True,
    ),
    Rule(
        "GENERIC_CREDIT",
        (
            Test(
                r"\<credited\>|\<deposited\>|\<received\>|\<refunded\>|\<reversed\>",
                ("credited|deposited|received|refunded|reversed",),
            ),
        ),
        channel=generic_channel,
        confidence=0.80,
        merchant_generic=True,
        merchant_null_if=(
            r"your\s+(credit\s+)?card\s+ending",
            r"YOUR\s+CREDIT\s+CARD\s+ENDING\s+WITH",
            r"your\s+rwallet",
            r"Meal\s+Wallet\s+on\s+",
        ),
        handle=True,
    ),
]

# Confidence by handle class for rules that read a handle.
HANDLE_CONFIDENCE = {"merchant": 0.85, "person": 0.75}

FIELDS = [
    "bank", "channel", "direction", "amount", "account_number_masked", "txn_date_raw", "merchant", "balance",
    "ref_number", "ref_type", "confidence", "possible_contra", "requires_classification", "vpa_type",
]


def message_day(date_ms: str) -> str:
    """UTC day of an epoch-millisecond time; the session time zone must be UTC."""
    return f"to_date(timestamp_millis({date_ms}))"


def _per_rule(rules: list[Rule], value: Callable[[Rule], str | None], default: str = "NULL") -> str:
    """CASE over the rule number; rules with equal expressions share a branch."""
    numbers: dict[str, list[int]] = {}
    for number, rule in enumerate(rules, start=1):
        sql = value(rule)
        if sql is not None:
            numbers.setdefault(sql, []).append(number)
    return first_of([(_in(found), sql) for sql, found in numbers.items()], default)


def _in(numbers: list[int]) -> str:
    return f"rule_no IN ({', '.join(map(str, numbers))})" if numbers else "false"


def _numbers(rules: list[Rule], pick: Callable[[Rule], bool]) -> str:
    return _in([n for n, rule in enumerate(rules, start=1) if pick(rule)])


def _constant(value: str | float | bool | None) -> str | None:
    return None if value is None else lit(value)


def families(rules: list[Rule]) -> dict[str, str]:
    """What a text must hold for a rule, if all its tests imply substrings; see ``functions/marks``."""
    return {
        f"rule {number}": phrases([word for test in rule.tests for word in test.anchors[-1].split("|")])
        for number, rule in enumerate(rules, start=1)
        if all(test.anchors for test in rule.tests)
    }


def with_rule(texts: DataFrame, rules: list[Rule] = RULES, marks: Marks | None = None) -> DataFrame:
    """Add ``rule_no``: the first rule whose tests hold on a message that passed the filter."""
    cases = []
    for number, rule in enumerate(rules, start=1):
        test = either([t.sql("_text", "_low") for t in rule.tests])
        if rule.unless:
            test = both([test, f"NOT {either([t.sql('_text', '_low') for t in rule.unless])}"])
        cases.append((ask(marks, f"rule {number}", test), str(number)))
    return texts.selectExpr("*", f"{first_of([('drop_reason IS NOT NULL', 'NULL'), *cases])} AS rule_no")


def _own_hits(patterns: tuple[str, ...]) -> str:
    return first_hit([grab("_text", p) for p in patterns])


def _amount(rules: list[Rule]) -> str:
    """Own amount clause, else the generic amount; an own clause without a positive value voids the match."""
    own = _per_rule(rules, lambda r: _own_hits(r.amount) if r.amount else None)
    clause = "try_cast(replace(c, ',', '') AS decimal(38,2))"
    values = f"transform(array({own}), c -> CASE WHEN c IS NULL THEN {X.amount('_text', '_low')} ELSE {clause} END)"
    return f"get(filter({values}, v -> v > 0), 0)"


def _merchant(rules: list[Rule]) -> str:
    def own(rule: Rule) -> str | None:
        steps = []
        if rule.merchant:
            captures = ", ".join(strip(grab("_text", p, flags=flags)) for p, flags in rule.merchant)
            found = f"get(filter(array({captures}), m -> m <> ''), 0)"
            if rule.merchant_format:
                before, after = rule.merchant_format.split("%s")
                found = f"concat({lit(before)}, {found}, {lit(after)})"
            steps.append(found)
        if rule.handle:
            steps.append(X.handle("_text", "_low"))
        if rule.merchant_generic:
            steps.append(X.merchant("_text", "_low"))
        if rule.merchant_constant:
            steps.append(lit(rule.merchant_constant))
        return coalesce(steps) if steps else None

    return _per_rule(rules, own)


def _checked_merchant(rules: list[Rule]) -> str:
    """Aliases and null guards on the merchant text found."""
    cases = [("_merchant = ''", "NULL")]
    for number, rule in enumerate(rules, start=1):
        if rule.merchant_alias:
            short, name = rule.merchant_alias
            bare = "regexp_replace(lower(_merchant), '[.]$', '')"
            cases.append((f"rule_no = {number} AND {bare} = {lit(short)}", lit(name)))
        if rule.merchant_null_if:
            guards = either([has("_merchant", p) for p in rule.merchant_null_if])
            cases.append((f"rule_no = {number} AND {guards}", "NULL"))
    return first_of(cases, "_merchant")


def _date(rules: list[Rule], marks: Marks | None = None) -> str:
    """Date in the text, else day and month in the text with the year of the message."""
    partial = _per_rule(rules, lambda r: grab("_text", r.partial_date, 0) if r.partial_date else None)
    day = "lpad(regexp_extract(d, '([0-9]{1,2})-', 1), 2, '0')"
    month = "regexp_extract(d, '-([0-9]{2})', 1)"
    year = f"year({message_day('date')})"
    full = f"transform(filter(array({partial}), d -> d <> ''), d -> concat({year}, '-', {month}, '-', {day}))"
    return coalesce([X.date_text("_text", "_low", marks), f"get({full}, 0)"])


def with_fields(routed: DataFrame, rules: list[Rule] = RULES, marks: Marks | None = None) -> DataFrame:
    """The fields of the matched rule, then what depends on them."""
    text, low = "_text", "_low"

    def text_value(value: str | Callable | None) -> str | None:
        if value is generic_channel:
            return generic_channel(text, marks)
        return value(text) if callable(value) else _constant(value)

    def direction(rule: Rule) -> str | None:
        if rule.discard:
            return None
        return text_value(rule.direction or ("credit" if "CREDIT" in rule.id else "debit"))

    def account(rule: Rule) -> str | None:
        steps = [_own_hits(rule.account)] if rule.account else []
        steps += [X.account(text, low)] if rule.account_generic else []
        return coalesce(steps) if steps else None

    def contra(rule: Rule) -> str:
        return X.is_self_transfer(low, marks) if rule.contra == "self_transfer" else lit(bool(rule.contra))

    def generic_reference(rule: Rule) -> bool:
        return rule.reference_generic and not rule.discard

    discards = _numbers(rules, lambda r: bool(r.discard))
    handles = _numbers(rules, lambda r: r.handle)
    matched = "rule_no IS NOT NULL"
    fields = {
        "rule_id": f"get({array([r.id for r in rules])}, rule_no - 1)",
        "discard_reason": _per_rule(rules, lambda r: _constant(r.discard), "CAST(NULL AS string)"),
        "bank": when(_numbers(rules, lambda r: r.bank), X.bank(low, marks)),
        "channel": _per_rule(rules, lambda r: text_value(r.channel), "CAST(NULL AS string)"),
        "direction": _per_rule(rules, direction, "CAST(NULL AS string)"),
        "amount": when(matched, _amount(rules)),
        "account_number_masked": _per_rule(rules, account, "CAST(NULL AS string)"),
        "txn_date_raw": when(_numbers(rules, lambda r: not r.discard), _date(rules, marks)),
        "_merchant": _merchant(rules),
        "_balance": when(_numbers(rules, lambda r: r.balance and not r.discard), X.balance(text, low)),
        "_own_ref": _per_rule(rules, lambda r: _own_hits((r.reference[0],)) if r.reference else None),
        "_own_ref_type": _per_rule(rules, lambda r: _constant(r.reference[1]) if r.reference else None),
        "_payment_ref": when(_numbers(rules, generic_reference), X.payment_reference(text, low)),
        "_transfer_ref": when(_numbers(rules, generic_reference), X.transfer_reference(text, low)),
        "_confidence": _per_rule(rules, lambda r: _constant(r.confidence), "CAST(NULL AS double)"),
        "possible_contra": _per_rule(rules, contra, "false"),
        "_handle": when(handles, X.handle(text, low)),
    }
    staged = routed.selectExpr("*", *[f"{sql} AS {name}" for name, sql in fields.items()])

    kind = X.handle_class("_handle")
    by_handle = ", ".join(f"{lit(name)}, {lit(value)}" for name, value in HANDLE_CONFIDENCE.items())
    needs_merchant = _numbers(rules, lambda r: r.review_without_merchant)
    outcome = first_of(
        [
            ("drop_reason IS NOT NULL", lit("dropped")),
            ("discard_reason IS NOT NULL", lit("discard")),
            ("amount IS NOT NULL", lit("matched")),
        ],
        lit("none"),
    )
    derived = {
        "merchant": _checked_merchant(rules),
        "balance": when(discards, "amount", "_balance"),
        "ref_number": "coalesce(_own_ref, _payment_ref, _transfer_ref)",
        "ref_type": first_of(
            [
                ("_own_ref IS NOT NULL", "_own_ref_type"),
                ("_payment_ref IS NOT NULL", lit("upi_rrn")),
                ("_transfer_ref IS NOT NULL", lit("neft_utr")),
            ]
        ),
        "confidence": f"coalesce(element_at(map({by_handle}), {kind}), _confidence)",
        "requires_classification": (
            f"coalesce({kind} IN ('person', 'unknown'), false) "
            f"OR coalesce({needs_merchant} AND _merchant IS NULL, false)"
        ),
        "vpa_type": kind,
        "outcome": outcome,
    }
    keep = [c for c in staged.columns if not c.startswith("_") or c in ("_text", "_low", "_marks")]
    return staged.selectExpr(*keep, *[f"{sql} AS {name}" for name, sql in derived.items()])


def with_l2(filtered: DataFrame, rules: list[Rule] = RULES, marks: Marks | None = None) -> DataFrame:
    """All routing stages on a frame that already carries the text columns and ``drop_reason``."""
    return with_fields(with_rule(filtered, rules, marks), rules, marks)


def route_messages(messages: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Filter and route messages; returns them with ``drop_reason``, ``rule_id``, ``outcome`` and ``l2``.

    ``outcome`` is ``dropped``, ``discard``, ``matched`` or ``none``. A rule that matches but finds no
    amount voids the match (``none``); later rules are not tried.
    """
    from tallymill.operators.filters import FAMILIES, with_drop_reason, with_text

    texts, marks = with_marks(with_text(messages), {**FAMILIES, **X.FAMILIES, **families(rules)})
    routed = with_l2(with_drop_reason(texts, marks), rules, marks)
    day = f"coalesce(txn_date_raw, CAST({message_day('date')} AS string))"
    parts = ", ".join(f"'{n}', {day if n == 'txn_date_raw' else n}" for n in FIELDS)
    columns = {
        "drop_reason": "drop_reason",
        "rule_id": "CASE WHEN outcome IN ('matched', 'discard') THEN rule_id END",
        "outcome": "outcome",
        "discard_reason": "discard_reason",
        "l2": f"CASE WHEN outcome = 'matched' THEN named_struct({parts}) END",
    }
    return select_sealed(routed, messages.columns, columns)
