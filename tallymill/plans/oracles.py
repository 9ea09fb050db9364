"""Independent answers to the named queries, as DuckDB SQL.

Message queries are answered from the order rows the messages were written from, without reading text:
the expected parse of each template is listed here by hand. Text queries over real prose use RE2.
"""

from __future__ import annotations

from tallymill.operators import filters, review, rules
from tallymill.plans.forms import CLAUSES, FALLBACK, FIELDS, SENDERS
from tallymill.plans.forms import expected as form_value
from tallymill.plans.planted import BANK, CHANNEL, SHORT_BANKS, expected
from tallymill.plans.queries import EXPORT_MS, NOW_MS

M = """m AS (SELECT o_orderkey AS k, o_custkey AS u, o_orderkey % 41 + 1 AS n, round(o_totalprice, 2) AS amt,
  lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') AS a4, CAST(100000000000 + o_orderkey AS VARCHAR) AS rrn,
  CAST(CAST(o_orderdate AS DATE) + INTERVAL 300 MONTH AS DATE) AS d FROM orders)"""

# Expected parse per template: a4/rrn/amt are the slots; anything else is a constant.
D, C = "debit", "credit"
EXPECTED: dict[int, dict] = {
    1: dict(stage="discard", rule="GENERIC_DECLINED", failure="declined_transaction"),
    2: dict(stage="discard", rule="GENERIC_CC_EMI_CONVERSION", failure="cc_emi_conversion_not_new_txn"),
    3: dict(stage="balance_update", rule="BALANCE_ALERT_ONLY", account="a4", balance="amt"),
    4: dict(rule="GENERIC_CC_SPEND_TXN", dir=D, account="a4", merchant="NORTH MART", channel="Credit Card", ref="rrn", ref_type="upi_rrn", conf=0.88),
    5: dict(rule="GENERIC_CC_PAYMENT", dir=D, account="a4", channel="Net Banking", conf=0.9, contra=True),
    6: dict(rule="PLUXEE_SPEND", dir=D, account="a4", merchant="NORTH MART", channel="Card", balance="2500.0", conf=0.88, label=("Expense", "Food & Dining", "Restaurants")),
    7: dict(rule="PLUXEE_CREDIT", dir=C, channel="Wallet", conf=0.88, contra=True, label=("Expense", "Food & Dining", "Restaurants")),
    8: dict(rule="NCMC_LOAD", dir=D, account="a4", channel="Card", conf=0.88, contra=True),
    9: dict(rule="GENERIC_WALLET_SPEND", dir=D, merchant="NORTH MART", channel="Wallet", conf=0.85),
    10: dict(rule="GENERIC_NETBANKING_PAYMENT", dir=D, account="a4", merchant="NORTH TRADERS", channel="Net Banking", conf=0.85),
    11: dict(rule="GENERIC_NACH", dir=D, account="a4", merchant="NORTH FINANCE", channel="NACH", conf=0.85, review=True, label=("Liability", "Recurring Payment", "NACH Mandate")),
    12: dict(rule="GENERIC_PPF_SSY", dir=D, account="a4", merchant="PPF / SSY Account", channel="NEFT", conf=0.92, contra=True, label=("Asset", "Government Schemes", "PPF/SSY")),
    13: dict(rule="LOAN_DISBURSEMENT", dir=C, account="a4", merchant="Loan Disbursement", channel="UPI", conf=0.9),
    14: dict(rule="CHEQUE_CLEARED_DEBIT", dir=D, account="a4", merchant="Cheque #123456", channel="Cheque", ref="123456", ref_type="cheque_number", conf=0.85),
    15: dict(rule="CARD_POS_USED_FOR", dir=D, account="a4", merchant="NORTH MART", channel="Card", conf=0.85),
    16: dict(rule="GENERIC_CHARGED", dir=D, merchant="Demo ride", channel="UPI", conf=0.82),
    17: dict(rule="CASH_DEPOSIT", dir=C, account="a4", merchant="Cash Deposit", channel="ATM", balance="9000.0", conf=0.85, contra=True),
    18: dict(rule="WALLET_LOAD", dir=C, merchant="DemoPay Wallet Load", channel="Wallet", conf=0.85, contra=True),
    19: dict(rule="GENERIC_PAID_TO", dir=D, merchant="North Traders", channel="UPI", ref="rrn", ref_type="upi_rrn", conf=0.82),
    20: dict(rule="GENERIC_PURCHASE_CONFIRMATION", dir=D, merchant="Demo", channel="UPI", conf=0.75, label=("Expense", "Utilities", "DTH & Cable TV")),
    21: dict(rule="DEMAND_DRAFT_ISSUED", dir=D, account="a4", merchant="Demand Draft #10000001", channel="DD", ref="10000001", ref_type="dd_number", conf=0.85),
    22: dict(rule="LEGACY_DR_CR_FORMAT", dir=D, account="a4", channel="UPI", balance="5000.0", conf=0.8),
    23: dict(rule="COURIER_COD_PAYMENT", dir=D, merchant="DemoCourier", channel="Cash", conf=0.7),
    24: dict(rule="REFUND_INITIATED", dir=C, account="a4", merchant="shoes", channel="Refund", conf=0.6, label=("Income", "Refunds", "Purchase Refund")),
    25: dict(rule="GENERIC_DEBIT", dir=D, account="a4", merchant="NORTH MART", channel="UPI", ref="rrn", ref_type="upi_rrn", conf=0.8),
    26: dict(rule="GENERIC_CREDIT", dir=C, account="a4", merchant="demo.user@okdemo", channel="UPI", ref="rrn", ref_type="upi_rrn", conf=0.75, review=True),
    27: dict(stage="escalated", dir=D, account="a4", failure="escalated_to_haiku"),
    28: dict(stage="fallback", dir=D, account="a4", conf=0.7, label=("Expense", "Entertainment", "OTT Subscriptions")),
    29: dict(stage="escalated", failure="unknown_direction", amount=False),
    30: dict(stage="escalated", dir=C, failure="missing_amount", amount=False),
}
DROPPED = {
    31: "sender", 32: "sender", 33: "otp", 34: "delivery", 35: "telecom", 36: "future_credit", 37: "loyalty",
    38: "promo", 39: "service_noise", 40: "no_signal", 41: "payee_ack",
}
QUIRKS = {
    "balance_before_load": dict(stage="balance_update", rule="BALANCE_ALERT_ONLY", account="a4", balance="amt"),
    "spent_with_paise": dict(rule="GENERIC_DEBIT", dir=D, account="a4", merchant="NORTH MART", channel="Card", conf=0.8),
    "paid_for": dict(rule="GENERIC_PAID_TO", dir=D, channel="UPI", conf=0.82),
    "dashed_date": dict(rule="GENERIC_DEBIT", dir=D, account="a4", channel="UPI", conf=0.8),
}


def q(value) -> str:
    """SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    return "'" + str(value).replace("'", "''") + "'"


def _slot(value: str | None) -> str:
    return value if value in ("a4", "rrn", "amt") else q(value)


def _has_amount(e: dict) -> bool:
    return e.get("stage", "matched") in ("matched", "fallback", "escalated") and e.get("amount", True)


def _review(e: dict) -> str:
    """SQL condition under which the row waits for review."""
    if e.get("failure") or e.get("review") or not e.get("account") or e.get("stage") == "balance_update":
        return "true"
    return "amt >= 5000"


def _signed(e: dict) -> str:
    return "NULL" if not _has_amount(e) else ("amt" if e.get("dir") == C else "-amt")


def parse_sql(e: dict) -> str:
    kind, category, sub = e.get("label", (None, None, None))
    balance = e.get("balance")
    return f"""WITH {M} SELECT CAST(k AS VARCHAR) AS msg_id, {q(e.get('stage', 'matched'))} AS stage,
  {q(e.get('rule'))} AS rule_id, {q(e.get('dir'))} AS direction, CAST({_signed(e)} AS DOUBLE) AS amount,
  {_slot(e.get('account'))} AS account, d AS txn_date, {q(e.get('merchant'))} AS merchant,
  CAST(NULL AS VARCHAR) AS bank, {q(e.get('channel'))} AS channel,
  CAST({balance or 'NULL'} AS DOUBLE) AS balance, {_slot(e.get('ref'))} AS ref_number,
  {q(e.get('ref_type'))} AS ref_type, CAST({e.get('conf', 'NULL')} AS DOUBLE) AS confidence,
  {q(e.get('contra', False))} AS possible_contra, {q(e.get('review', False))} AS requires_classification,
  {q(kind)} AS type, {q(category)} AS category, {q(sub)} AS sub_category,
  CASE WHEN {_review(e)} THEN 'pending_review' ELSE 'approved' END AS status,
  {q(e.get('failure'))} AS parse_failure FROM m"""


def _case(values: dict[int, str]) -> str:
    return "CASE n " + " ".join(f"WHEN {n} THEN {v}" for n, v in values.items()) + " END"


def _per_template(pick) -> str:
    return _case({n: pick(e) for n, e in EXPECTED.items()})


STAGE = (
    "CASE WHEN n > 30 THEN 'dropped' ELSE " + _per_template(lambda e: q(e.get("stage", "matched"))) + " END"
)
DROP = _case({n: q(reason) for n, reason in DROPPED.items()})
RULE = _per_template(lambda e: q(e.get("rule")))
REVIEW = _per_template(_review)
SIGNED = _per_template(_signed)
FAILURE = _per_template(lambda e: q(e.get("failure")))
CATEGORY = _per_template(lambda e: q(e.get("label", (None, None, None))[1]))
# Every message with its expected verdict.
V = f"""{M}, v AS (SELECT *, {STAGE} AS stage, {DROP} AS drop_reason, {RULE} AS rule, {REVIEW} AS waits,
  {SIGNED} AS amount, {FAILURE} AS failure, {CATEGORY} AS category FROM m)"""

LEDGER = """l AS (SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id,
  'A' || CAST(event_id % 3 AS VARCHAR) AS account_id, CAST(ts AS DATE) AS txn_date,
  CASE WHEN event_type IN ('purchase', 'error') THEN 0 - floor(value) ELSE floor(value) END AS amount,
  CASE WHEN event_id % 4 < 2 THEN CAST(user_id AS VARCHAR) || '-' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS ref_number,
  CASE WHEN event_id % 5 = 0 THEN 'user_reviewed' WHEN event_id % 5 < 3 THEN 'pending_review' ELSE 'approved' END AS status,
  event_id % 50 = 7 AS is_infrastructure, event_id % 40 = 11 AS is_contra,
  CASE event_type WHEN 'signup' THEN 'income' WHEN 'purchase' THEN 'shopping' ELSE event_type END AS category,
  CASE WHEN event_type = 'purchase' THEN 'Expense' ELSE 'Income' END AS type,
  CASE WHEN event_id % 3 = 0 THEN 'Shop ' || CAST(event_id % 7 AS VARCHAR) END AS merchant,
  event_id, ts AS created_at FROM events)"""

FLAGS = f"""{LEDGER}, f AS (SELECT l.*, (SELECT struct_pack(id := c.id, ref := c.ref_number) FROM l c
    WHERE c.user_id = l.user_id AND c.account_id = l.account_id AND c.txn_date = l.txn_date AND c.amount = l.amount
      AND NOT c.is_contra AND (c.created_at, c.id) < (l.created_at, l.id)
    ORDER BY c.status = 'user_reviewed', c.created_at, c.id LIMIT 1) AS cand FROM l),
  g AS (SELECT *, NOT is_contra AND cand IS NOT NULL AS hit FROM f),
  flagged AS (SELECT id, CASE WHEN hit THEN cand.id END AS possible_duplicate_of,
    CASE WHEN hit THEN CASE WHEN ref_number = cand.ref THEN 0.95 ELSE 0.6 END END AS duplicate_confidence,
    CASE WHEN hit AND status <> 'user_reviewed' THEN 'pending_review' ELSE status END AS status FROM g)"""

PAIRS = f"""{LEDGER}, legs AS (SELECT * FROM l WHERE NOT is_infrastructure AND NOT is_contra AND amount <> 0),
  p AS (SELECT a.id, a.user_id, b.id AS partner_id,
    CASE WHEN b.status = 'user_reviewed' THEN 3 WHEN a.ref_number = b.ref_number THEN 1 ELSE 2 END AS tier,
    b.status <> 'user_reviewed' AS open, b.created_at AS seen_at
    FROM legs a JOIN legs b ON a.user_id = b.user_id AND a.amount = -b.amount AND a.account_id <> b.account_id
      AND abs(date_diff('day', a.txn_date, b.txn_date)) <= 1
    WHERE a.status <> 'user_reviewed'),
  best AS (SELECT id, user_id, count(*) FILTER (WHERE open) OVER (PARTITION BY id) AS candidates, tier, partner_id,
    row_number() OVER (PARTITION BY id ORDER BY tier, seen_at, partner_id) AS rn FROM p)"""

#: One row of a replayed group. ord: place by time and id. here: has arrived. at: time of the arrival that made it a transfer.
REPLAYED = ["ord", "id", "sign", "day", "acc", "ref", "status", "infra", "contra", "link", "grp", "dup", "dupref", "here", "at", "seen"]


def _row(x: str, **changes: str) -> str:
    return "struct_pack(" + ", ".join(f"{f} := {changes.get(f, f'{x}.{f}')}" for f in REPLAYED) + ")"


# Rows of a group arrive one by one, and each arrival or search for a partner is a step: cur is the row that searches, 0 if
# the next one arrives. The first of the least tier is taken; whom it displaces searches next, five levels deep at most.
REPLAY = f"""{LEDGER}, a AS (SELECT user_id, abs(amount) AS mag, row_number() OVER (PARTITION BY user_id, abs(amount) ORDER BY created_at, id) AS ord,
    id, CAST(sign(amount) AS INTEGER) AS sign, txn_date AS day, account_id AS acc, ref_number AS ref, status, is_infrastructure AS infra, is_contra AS contra,
    CAST(NULL AS VARCHAR) AS link, CAST(NULL AS VARCHAR) AS grp, CAST(NULL AS VARCHAR) AS dup, CAST(NULL AS VARCHAR) AS dupref,
    status = 'user_reviewed' AS here, CAST(NULL AS TIMESTAMP) AS at, CAST(created_at AS TIMESTAMP) AS seen FROM l WHERE amount <> 0),
  g AS (SELECT user_id, mag, list({_row('a')} ORDER BY here DESC, ord) AS rows, 1 + count(*) FILTER (WHERE here) AS pos FROM a GROUP BY ALL),
  s AS (SELECT user_id, mag, rows, CAST(pos AS BIGINT) AS pos, CAST(0 AS BIGINT) AS cur, 0 AS depth FROM g
    UNION ALL SELECT user_id, mag,
      CASE WHEN cur = 0 THEN list_transform(rows, lambda x, i: CASE WHEN i = pos THEN {_row('x', here='true',
          status="CASE WHEN twin IS NOT NULL AND NOT t.contra THEN 'pending_review' ELSE x.status END",
          dup='CASE WHEN NOT t.contra THEN twin.id END', dupref='CASE WHEN NOT t.contra THEN twin.ref END')} ELSE x END)
        WHEN best IS NULL THEN rows
        WHEN best.tier = 3 THEN list_transform(rows, lambda x, i: CASE WHEN i = cur THEN {_row('x', status="'pending_review'", link='best.id')} ELSE x END)
        ELSE list_transform(rows, lambda x, i: CASE WHEN x.id = t.id OR x.id = best.id THEN {_row('x', contra='best.tier = 1',
          link='CASE WHEN best.tier = 2 THEN CASE WHEN x.id = t.id THEN best.id ELSE t.id END END',
          grp="CASE WHEN best.tier = 1 THEN coalesce(best.grp, t.grp, sha256(least(t.id, best.id) || '|' || greatest(t.id, best.id))) ELSE x.grp END",
          at='CASE WHEN best.tier = 1 THEN rows[pos].seen ELSE x.at END')} WHEN x.id = stale THEN {_row('x', link='NULL')} ELSE x END) END,
      CASE WHEN goes THEN pos ELSE pos + 1 END,
      CASE WHEN NOT goes THEN 0 WHEN cur = 0 THEN pos ELSE list_position(list_transform(rows, lambda x: x.id), stale) END,
      CASE WHEN cur = 0 OR NOT goes THEN 0 ELSE depth + 1 END
    FROM (SELECT *, CASE WHEN best.tier < 3 AND best.link <> t.id THEN best.link END AS stale,
        CASE WHEN cur = 0 THEN NOT t.contra AND NOT t.infra
          ELSE coalesce(best.tier < 3 AND best.link <> t.id AND depth < 5 AND NOT list_filter(rows, lambda x: x.id = best.link)[1].contra, false) END AS goes
      FROM (SELECT *, list_min(list_transform(list_filter(rows, lambda x: cur = 0 AND x.here AND NOT x.contra AND x.sign = t.sign AND x.day = t.day AND x.acc = t.acc),
            lambda x: struct_pack(late := x.status = 'user_reviewed', ord := x.ord, id := x.id, ref := x.ref))) AS twin,
          list_min(list_transform(list_filter(rows, lambda x: cur > 0 AND x.here AND NOT x.contra AND NOT x.infra AND x.sign = -t.sign
              AND abs(date_diff('day', x.day, t.day)) <= 1 AND x.acc <> t.acc),
            lambda x: struct_pack(tier := CASE WHEN x.status = 'user_reviewed' THEN 3 WHEN x.ref = t.ref THEN 1 ELSE 2 END, ord := x.ord, id := x.id, link := x.link, grp := x.grp))) AS best
        FROM (SELECT *, CASE WHEN cur = 0 THEN rows[pos] ELSE rows[cur] END AS t FROM s WHERE pos <= len(rows))))),
  w AS (SELECT user_id, unnest(rows) AS r FROM s WHERE pos > len(rows)),
  made AS (SELECT user_id, r.ref AS ref, arg_max(r.grp, (r.at, r.id)) AS grp, max(r.at) AS at FROM w WHERE r.at IS NOT NULL AND r.ref IS NOT NULL GROUP BY 1, 2),
  paired AS (SELECT l.id, l.user_id, l.amount, l.ref_number, l.is_infrastructure, coalesce(r.status, l.status) AS status, coalesce(r.contra, l.is_contra) AS is_contra,
    r.link AS possible_contra_of, CASE WHEN l.is_infrastructure AND l.created_at <= made.at THEN made.grp ELSE r.grp END AS txn_group_id,
    r.dup AS possible_duplicate_of, CASE WHEN r.dup IS NOT NULL THEN CASE WHEN l.ref_number = r.dupref THEN 0.95::DOUBLE ELSE 0.6::DOUBLE END END AS duplicate_confidence
    FROM l LEFT JOIN w ON w.r.id = l.id LEFT JOIN made ON made.user_id = l.user_id AND made.ref = l.ref_number)"""

LINES = """r1 AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS id, CAST(l_suppkey AS VARCHAR) AS user_id,
  CAST(l_partkey AS VARCHAR) AS part, l_orderkey % 2 = 0 AS has_ref, l_quantity AS amount,
  date_trunc('month', l_shipdate) AS txn_date, CASE WHEN l_linenumber < 6 THEN l_suppkey % 3 END AS account,
  CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 3 END AS priority, l_shipdate AS seen_at, l_orderkey % 10 = 0 AS twin FROM lineitem),
  r AS (SELECT * FROM r1 UNION ALL SELECT * REPLACE ('twin-' || user_id AS user_id) FROM r1 WHERE twin),
  k1 AS (SELECT *, row_number() OVER (PARTITION BY user_id, has_ref, part ORDER BY seen_at, id) AS nth FROM r),
  k2 AS (SELECT *, max(priority) OVER (PARTITION BY user_id, amount, txn_date, account ORDER BY seen_at, id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS holder,
    row_number() OVER (PARTITION BY user_id, amount, txn_date, account ORDER BY priority DESC, seen_at, id) AS place
    FROM k1 WHERE nth = 1 AND account IS NOT NULL),
  logged AS (SELECT user_id, id, CASE WHEN has_ref THEN 'duplicate_rrn' ELSE 'duplicate_body' END AS reason FROM k1 WHERE nth > 1
    UNION ALL SELECT user_id, id, CASE WHEN priority > holder THEN 'contra_replaced_existing' ELSE 'contra_lower_priority' END
    FROM k2 WHERE holder IS NOT NULL)"""

# --- text over documents -----------------------------------------------------------------------

BLANKS = "               　﻿"
DOCS = f"t AS (SELECT doc_id, translate(text, '{BLANKS}', '{' ' * len(BLANKS)}') AS b, lower(translate(text, '{BLANKS}', '{' ' * len(BLANKS)}')) AS lo FROM documents)"


def re2(pattern: str, flags: str = "") -> str:
    """RE2 text of a marked pattern; flags go inline, blanks get the vertical tab RE2 leaves out."""
    text = pattern.replace(r"\<", r"\b").replace(r"\>", r"\b")
    return q((f"(?{flags})" if flags else "") + text)


def m(col: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({col}, {re2(pattern, flags)})"


def x(col: str, pattern: str, flags: str = "", group: int = 1) -> str:
    return f"nullif(regexp_extract({col}, {re2(pattern, flags)}, {group}), '')"


def anyof(col: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(p)})" for p in phrases) + ")"


def allof(col: str, phrases: list[str]) -> str:
    return "(" + " AND ".join(f"contains({col}, {q(p)})" for p in phrases) + ")"


def num(text: str) -> str:
    return f"TRY_CAST(replace({text}, ',', '') AS DECIMAL(38,2))"


MONEY = r"([\d,]+(?:\.\d{1,2})?)"


def body_reason(lo: str) -> str:
    f = filters
    marker = f"({anyof(lo, f.CURRENCY)} OR {m(lo, 'rs[0-9]')})"
    url = f"({anyof(lo, f.PROMO_URL)} OR {' OR '.join(allof(lo, pair) for pair in f.PROMO_SHORT_URL)})"
    ref = f"({' OR '.join(m(lo, p) for p in f.PROMO_ACCOUNT)} OR (contains({lo}, 'your account') AND {anyof(lo, ['debited', 'credited'])}))"
    service = " OR ".join(
        [anyof(lo, f.SERVICE), m(lo, f.SERVICE_FARE), f"(contains({lo}, 'claim') AND {anyof(lo, f.CLAIM_STATUS)})"]
        + [allof(lo, g) for g in f.SERVICE_TOGETHER]
        + [f"({anyof(lo, f.FUND_CONTRIBUTION)} AND {anyof(lo, f.FUND_CREDITED)})"]
    )
    direction = " OR ".join([anyof(lo, f.DIRECTION)] + [m(lo, p) for p in (f.DIRECTION_WDL, f.DIRECTION_LEGACY, f.DIRECTION_USING_CARD)])
    ack = f"({anyof(lo, f.ACKNOWLEDGED)} OR {allof(lo, ['is successful', 'recharge'])} OR (contains({lo}, 'has been activated') AND {anyof(lo, ['inr', 'rs.'])}))"
    account = " OR ".join(m(lo, p) for p in f.BANK_ACCOUNT)
    return f"""CASE WHEN {anyof(lo, f.OTP)} THEN 'otp' WHEN NOT {marker} AND {anyof(lo, f.DELIVERY)} THEN 'delivery'
    WHEN {anyof(lo, f.TELECOM)} THEN 'telecom' WHEN {m(lo, f.FUTURE_CREDIT)} THEN 'future_credit'
    WHEN {m(lo, f.LOYALTY)} THEN 'loyalty' WHEN {anyof(lo, f.OFFER)} AND {url} AND NOT {ref} THEN 'promo'
    WHEN {service} THEN 'service_noise'
    WHEN NOT (({marker} OR {m(lo, f.BARE_MONEY)}) AND ({direction})) THEN 'no_signal'
    WHEN {ack} AND NOT ({account}) THEN 'payee_ack' END"""


def all_oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    for number, rule in enumerate(rules.RULES, start=1):
        o[f"parse_{rule.id.lower()}"] = parse_sql(EXPECTED[number])
    for number, name in ((27, "escalated"), (28, "classified"), (29, "no_direction"), (30, "no_amount")):
        o[f"fallback_{name}"] = parse_sql(EXPECTED[number])
    for name, e in QUIRKS.items():
        o[f"quirk_{name}"] = parse_sql(e)
    o["monthly_debits"] = f"""WITH {M} SELECT CAST(u AS VARCHAR) AS user_id, CAST(date_trunc('month', d) AS DATE) AS month,
      CAST(sum(CAST(amt AS DECIMAL(38,2))) AS DOUBLE) AS debit_total, count(*) AS debits FROM m GROUP BY 1, 2"""
    o["filter_drop_reasons"] = f"WITH {V} SELECT drop_reason, count(*) AS n FROM v WHERE drop_reason IS NOT NULL GROUP BY 1"
    o["rule_hits"] = f"WITH {V} SELECT rule AS rule_id, count(*) AS n FROM v WHERE rule IS NOT NULL GROUP BY 1"
    o["sender_inventory"] = f"WITH {M} SELECT CASE WHEN n = 31 THEN 'AD-DEMOBK-P' ELSE 'VM-DEMOBK-S' END AS address, count(*) AS n FROM m WHERE n <> 32 GROUP BY 1"
    o["sender_totals"] = f"WITH {M} SELECT count(*) AS total_count, CAST(2 AS BIGINT) AS senders FROM m"
    o["review_routing"] = f"""WITH {V} SELECT coalesce(rule, 'fallback') AS rule, CASE WHEN waits THEN 'pending_review' ELSE 'approved' END AS status,
      count(*) AS n FROM v WHERE stage IN ('matched', 'fallback') GROUP BY 1, 2"""
    o["failure_breakdown"] = f"WITH {V} SELECT failure AS parse_failure, count(*) AS n FROM v WHERE failure IS NOT NULL GROUP BY 1"
    row = "stage IN ('matched', 'fallback', 'escalated', 'discard')"
    o["category_breakdown"] = f"WITH {V} SELECT coalesce(category, 'unclassified') AS category, count(*) AS n FROM v WHERE {row} GROUP BY 1"
    o["category_crosswalk"] = f"""WITH {V} SELECT category, count(*) AS n, count(*) AS shown_uncategorized FROM v
      WHERE category IS NOT NULL GROUP BY 1"""
    o["parse_summary"] = f"""WITH {V} SELECT count(*) FILTER (WHERE {row}) AS total, count(*) FILTER (WHERE {row} AND NOT waits) AS approved,
      count(*) FILTER (WHERE {row} AND waits) AS pending_review, count(failure) AS parse_failures,
      count(*) FILTER (WHERE stage = 'balance_update') AS balance_updates FROM v"""
    o["funnel"] = f"""WITH {V}, c AS (SELECT count(*) AS total, count(*) FILTER (WHERE drop_reason = 'sender') AS sender_dropped,
      count(*) FILTER (WHERE drop_reason <> 'sender') AS body_dropped, count(*) FILTER (WHERE drop_reason IS NULL) AS passed,
      count(*) FILTER (WHERE stage = 'matched') AS matched, count(*) FILTER (WHERE stage IN ('discard', 'balance_update')) AS discarded,
      count(*) FILTER (WHERE stage IN ('fallback', 'escalated')) AS escalated FROM v)
      SELECT *, round(sender_dropped * 100.0 / total, 1) AS sender_drop_rate, round(body_dropped * 100.0 / total, 1) AS body_drop_rate,
      round(matched * 100.0 / passed, 1) AS match_rate FROM c"""
    real = "drop_reason IN ('otp', 'future_credit', 'loyalty', 'service_noise', 'no_signal', 'payee_ack')"
    o["fp_fn"] = f"WITH {V} SELECT CASE WHEN {real} THEN 'dropped_real' ELSE 'agreed' END AS verdict, count(*) AS n FROM v GROUP BY 1"
    histograms = {"drop_reasons": "filter_drop_reasons", "rule_hits": "rule_hits", "failure_breakdown": "failure_breakdown", "category_breakdown": "category_breakdown", "filter_quality": "fp_fn"}
    totals = {"funnel": "total, sender_dropped, body_dropped, passed, matched, discarded, escalated", "parse_summary": "total, approved, pending_review, parse_failures, balance_updates"}
    o["all_reports"] = " UNION ALL ".join(
        [f"SELECT '{report}' AS report, h.value, h.n FROM ({o[query]}) AS h(value, n)" for report, query in histograms.items()]
        + [f"SELECT '{report}', value, n FROM (UNPIVOT (SELECT {names} FROM ({o[report]})) ON {names} INTO NAME value VALUE n)" for report, names in totals.items()]
    )
    o["escalation_queue"] = f"""WITH {V} SELECT CAST(k AS VARCHAR) AS id, failure AS original_parse_failure, CAST(amount AS DOUBLE) AS original_amount
      FROM v WHERE stage IN ('fallback', 'escalated')"""
    o["window_labels"] = f"""WITH {M}, a AS (SELECT {NOW_MS} - epoch_ms(CAST(d AS TIMESTAMP) + INTERVAL 12 HOUR) AS age FROM m)
      SELECT CASE WHEN age < 0 THEN 'older' WHEN age < 7776000000 THEN '0 → 90 days' WHEN age < 15552000000 THEN '90 → 180 days'
        WHEN age < 23328000000 THEN '180 → 270 days' WHEN age < 31104000000 THEN '270 → 360 days' ELSE 'older' END AS "window",
      count(*) AS n FROM a GROUP BY 1"""
    forms = [
        ("iso", True), ("slash", True), ("short_dash", True), ("short_slash", True), ("month_long", True),
        ("month_short", True), ("legacy", True), ("dashed_long", False),
    ]
    o["extract_date_formats"] = f"WITH {M} " + " UNION ALL ".join(
        f"SELECT k AS o_orderkey, '{form}' AS form, {'d' if read else 'CAST(NULL AS DATE)'} AS found FROM m" for form, read in forms
    )
    o["vpa_class"] = """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'person' WHEN 1 THEN 'merchant' WHEN 3 THEN 'person' WHEN 4 THEN 'person'
      WHEN 2 THEN 'person' ELSE 'unknown' END AS vpa_type FROM customer"""
    # documents and conversations
    # a delivery notice counts only without a currency mark, and prose can hold one
    mark = "contains(t, 'rs.') OR contains(t, 'rs ') OR contains(t, 'inr') OR contains(t, '₹') OR regexp_matches(t, 'rs[0-9]')"
    o["body_filter_documents"] = f"""WITH z AS (SELECT doc_id, lower(text) AS t FROM documents)
      SELECT doc_id, CASE WHEN doc_id % 10 = 1 AND ({mark}) THEN 'no_signal' ELSE {expected('body_filter_documents')} END AS drop_reason FROM z"""
    o["body_filter_conversations"] = f"""WITH t AS (SELECT conv_id, turn, role, lower(translate(text, '{BLANKS}', '{' ' * len(BLANKS)}')) AS lo FROM conversations)
      SELECT conv_id, turn, {body_reason('lo')} AS drop_reason FROM t"""
    for name, column, kind in (
        ("extract_amount", "amount", "DOUBLE"), ("extract_account", "account", "VARCHAR"), ("extract_reference", "reference", "VARCHAR"),
        ("extract_balance", "balance", "DOUBLE"), ("self_transfer_detect", "self_transfer", "BOOLEAN"),
        ("taxonomy_best", "entry", "INT"),
    ):
        o[name] = f"SELECT doc_id, CAST({expected(name)} AS {kind}) AS {column} FROM documents"
    o["direction_vote"] = f"""SELECT doc_id, {expected('direction_vote', 0)} AS debit_votes, {expected('direction_vote', 1)} AS credit_votes,
      {expected('direction_vote', 2)} AS direction FROM documents"""
    # a short token in the prose itself wins over a later planted one
    long = len(BANK) - SHORT_BANKS
    short = " ".join(
        f"WHEN contains(s, {q(token)}) OR doc_id % {len(BANK)} = {long + i} THEN {q(name)}" for i, (token, name) in enumerate(BANK[long:])
    )
    o["bank_detect"] = rf"""WITH z AS (SELECT doc_id, regexp_replace(regexp_replace(lower(text[:length(text) // 2]), '\S+@\S+', ' ', 'g'), '[\s\-_/\.]', '', 'g') || '|' ||
        regexp_replace(regexp_replace(lower(text[length(text) // 2 + 1:]), '\S+@\S+', ' ', 'g'), '[\s\-_/\.]', '', 'g') AS s FROM documents)
      SELECT doc_id, CASE WHEN doc_id % {len(BANK)} < {long} THEN {expected('bank_detect')} ELSE CASE {short} END END AS bank FROM z"""
    # the halves of a text can end or begin with NACH or ECS, between accented letters too, which are no letters in ASCII terms
    o["channel_detect"] = f"""SELECT doc_id, CASE WHEN doc_id % {len(CHANNEL)} > 0 AND regexp_matches(text[:length(text) // 2] || chr(10) || text[length(text) // 2 + 1:], '(?i)\\b(?:NACH|ECS)\\b') THEN 'NACH'
      ELSE {expected('channel_detect')} END AS channel FROM documents"""
    # deduplication, duplicates, transfers
    o["dedup_reference_or_body"] = f"WITH {LINES} SELECT user_id, id, reason FROM logged WHERE reason LIKE 'duplicate%'"
    o["dedup_priority"] = f"""WITH {LINES} SELECT user_id, id, 'kept' AS verdict FROM k1 WHERE nth = 1 AND account IS NULL
      UNION ALL SELECT user_id, id, 'kept' FROM k2 WHERE place = 1 UNION ALL SELECT user_id, id, reason FROM logged WHERE reason LIKE 'contra%'"""
    o["dedup_by_reason"] = f"WITH {LINES} SELECT reason, count(*) AS n FROM logged GROUP BY 1"
    o["duplicate_flags"] = f"WITH {FLAGS} SELECT * FROM flagged WHERE possible_duplicate_of IS NOT NULL"
    o["duplicate_decisions"] = f"""WITH {FLAGS}, d AS (SELECT CASE WHEN duplicate_confidence < 0.9 THEN 'approved' ELSE status END AS status,
      coalesce(duplicate_confidence > 0.9, false) AS is_deleted, CASE WHEN duplicate_confidence > 0.9 THEN possible_duplicate_of END AS link FROM flagged)
      SELECT status, is_deleted, count(*) AS n, count(link) AS flagged FROM d GROUP BY 1, 2"""
    o["transfer_candidates"] = f"WITH {PAIRS} SELECT id, user_id, candidates, tier, partner_id FROM best WHERE rn = 1"
    o["transfer_tiers"] = f"WITH {PAIRS} SELECT tier, count(*) AS n, CAST(sum(candidates) AS BIGINT) AS candidates FROM best WHERE rn = 1 GROUP BY 1"
    o["stream_transfers"] = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS user_id, 'A' || CAST(event_id % 3 AS VARCHAR) AS account, CAST(ts AS DATE) AS day,
      CASE WHEN event_type IN ('purchase', 'error') THEN -floor(value) ELSE floor(value) END AS amount FROM events)
      SELECT DISTINCT a.user_id, b.amount AS magnitude, a.account AS debit_account, a.day AS debit_day, b.account AS credit_account, b.day AS credit_day FROM e a JOIN e b ON a.user_id = b.user_id AND a.amount = -b.amount AND a.account <> b.account
      AND abs(date_diff('day', a.day, b.day)) <= 1 WHERE a.amount < 0"""
    o["transfer_pairs_exact"] = f"""WITH RECURSIVE {REPLAY} SELECT id, status, is_contra, possible_contra_of, txn_group_id, possible_duplicate_of, duplicate_confidence FROM paired"""
    o["infra_group_spread"] = f"WITH RECURSIVE {REPLAY} SELECT id, ref_number, txn_group_id FROM paired WHERE is_infrastructure"
    o["transfer_decisions"] = f"""WITH RECURSIVE {REPLAY}, asked AS (SELECT p.id, p.possible_contra_of AS other, p.amount > 100 AS yes, q.status = 'user_reviewed' AS one_way
        FROM paired p JOIN paired q ON q.id = p.possible_contra_of),
      c AS (SELECT unnest(CASE WHEN yes AND one_way THEN [id] ELSE [id, other] END) AS id, yes,
        CASE WHEN yes THEN sha256(least(id, other) || '|' || greatest(id, other)) END AS grp FROM asked),
      d AS (SELECT id, bool_or(yes) AS yes, min(grp) AS grp FROM c GROUP BY id)
      SELECT p.id, p.is_contra OR coalesce(d.yes, false) AS is_contra, CASE WHEN d.id IS NULL THEN p.possible_contra_of END AS possible_contra_of,
        CASE WHEN d.yes THEN d.grp ELSE p.txn_group_id END AS txn_group_id FROM paired p LEFT JOIN d USING (id)"""
    o["transfer_notes"] = f"""WITH RECURSIVE {REPLAY} SELECT p.id, p.user_id, q.id AS partner_id, q.status AS partner_status,
      CASE WHEN q.status = 'user_reviewed' THEN {q(review.HISTORY_NOTE)} ELSE {q(review.TRANSFER_NOTE)} END AS note
      FROM paired p JOIN paired q ON q.id = p.possible_contra_of AND q.user_id = p.user_id WHERE NOT p.is_contra"""
    # a day is closed when the watermark, two days behind, is past all that can meet it
    o["stream_transfer_rows"] = f"""WITH {PAIRS} SELECT legs.id, legs.user_id, coalesce(candidates, 0) AS candidates, tier, partner_id
      FROM legs LEFT JOIN (SELECT * FROM best WHERE rn = 1) AS b ON b.id = legs.id
      WHERE legs.status <> 'user_reviewed' AND date_diff('day', legs.txn_date, (SELECT max(txn_date) FROM legs)) >= 5"""
    # a run is closed four days after its last day: two of lateness, two until nothing can join it
    o["stream_pairing"] = f"""WITH RECURSIVE {REPLAY}, y AS (SELECT user_id, unnest(rows, recursive := true), mag FROM s WHERE pos > len(rows)),
      n AS (SELECT *, coalesce(date_diff('day', lag(day) OVER (PARTITION BY user_id, mag ORDER BY day), day) > 1, true) AS starts FROM (SELECT DISTINCT user_id, mag, day FROM y)),
      k AS (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY user_id, mag ORDER BY day) AS nr FROM n),
      e AS (SELECT *, min(day) OVER (PARTITION BY user_id, mag, nr) AS run, max(day) OVER (PARTITION BY user_id, mag, nr) AS last FROM k)
      SELECT y.id, CAST(e.run AS DATE) AS run, y.status, y.contra AS is_contra, y.link AS possible_contra_of, y.grp AS txn_group_id, y.dup AS possible_duplicate_of, y.dupref AS duplicate_ref
      FROM y JOIN e USING (user_id, mag, day) WHERE date_diff('day', e.last, (SELECT max(day) FROM y)) >= 4"""
    # accounts and balances
    stored = "s AS (SELECT c_custkey AS u, lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS num FROM customer WHERE c_acctbal > 0)"
    number = _per_template(lambda e: "a4" if e.get("account") else "'UNKNOWN'")
    channel = _per_template(lambda e: q(e.get("channel")))
    o["account_dim"] = f"""WITH {V}, {stored}, w AS (SELECT u, d, CAST(k AS VARCHAR) AS k, {number} AS num, {channel} AS channel FROM v WHERE stage <> 'dropped'),
      first AS (SELECT u, num, arg_min(coalesce(channel, ''), (-epoch(d), k)) AS channel FROM w GROUP BY 1, 2)
      SELECT CAST(u AS VARCHAR) AS user_id, num AS account_number_masked, 'bank' AS account_type, 'Demo Bank' AS institution_name, true AS aa_linked FROM s
      UNION ALL SELECT CAST(u AS VARCHAR), num, CASE WHEN channel = 'Credit Card' THEN 'credit_card' ELSE 'bank' END,
        CASE WHEN num = 'UNKNOWN' THEN 'Unknown' END, false FROM first f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.u = f.u AND s.num = f.num)"""
    o["balance_latest"] = f"""WITH {M}, b AS (SELECT u, max(d) AS d, arg_max(amt, (d, CAST(k AS VARCHAR))) AS amt FROM m GROUP BY u)
      SELECT 'stored-' || c_custkey AS id, CASE WHEN b.d > DATE '2023-06-30' THEN b.amt ELSE c_acctbal END AS balance_latest,
      CASE WHEN b.d > DATE '2023-06-30' THEN b.d ELSE DATE '2023-06-30' END AS balance_updated_at
      FROM customer LEFT JOIN b ON b.u = c_custkey WHERE c_acctbal > 0
      UNION ALL SELECT sha256(CAST(u AS VARCHAR) || '|' || lpad(CAST(u % 10000 AS VARCHAR), 4, '0')), amt, d FROM b
      WHERE u NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"""
    o["stream_balance"] = f"""WITH {M} SELECT CAST(u AS VARCHAR) AS user_id, a4 AS account_number_masked, arg_max(amt, (d, CAST(k AS VARCHAR))) AS balance,
      max(d) AS message_date FROM m WHERE n = 3 GROUP BY u, a4"""
    # review, edits
    o["feed_page"] = f"""WITH {LEDGER}, f AS (SELECT * FROM l WHERE user_id = '8' AND status <> 'user_reviewed')
      SELECT id, txn_date, CAST(amount AS DOUBLE) AS amount, status, (SELECT count(*) FROM f) AS total_count,
      CAST(greatest(1, ceil((SELECT count(*) FROM f) / 20.0)) AS INT) AS page_count FROM f ORDER BY txn_date DESC, id LIMIT 20 OFFSET 20"""
    open_feed = f"""{LEDGER}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY txn_date DESC, id) - 1 AS place,
      count(*) OVER (PARTITION BY user_id) AS total_count FROM l WHERE status <> 'user_reviewed')"""
    o["feed_page_index"] = f"""WITH {open_feed} SELECT user_id, CAST(place // 20 AS INT) AS page, id, total_count,
      CAST(greatest(1, ceil(total_count / 20.0)) AS INT) AS page_count FROM f WHERE place % 20 = 0"""
    o["feed_page_seek"] = f"""WITH {open_feed} SELECT CAST(place // 20 AS INT) AS page, id, txn_date, CAST(amount AS DOUBLE) AS amount, status FROM f
      WHERE user_id = '8' AND place >= 20 AND place < 60"""
    o["maintained_counts"] = o["stream_counts"] = f"""WITH {LEDGER}, c AS (
      SELECT user_id, event_id % 6 = 1 AS gone, CASE WHEN event_id % 6 <> 1 AND event_id % 4 = 0 THEN 'user_reviewed' ELSE status END AS status FROM l
      UNION ALL SELECT user_id, false, 'pending_review' FROM l WHERE event_id % 10 = 3)
      SELECT user_id, count(*) FILTER (WHERE NOT gone AND status = 'pending_review') AS needs_review, count(*) FILTER (WHERE NOT gone AND status <> 'user_reviewed') AS active_total,
      count(*) FILTER (WHERE NOT gone AND status = 'user_reviewed') AS history_total, true AS has_any FROM c GROUP BY 1"""
    o["feed_history"] = f"WITH {LEDGER} SELECT user_id, count(*) AS n FROM l WHERE status = 'user_reviewed' AND category = 'shopping' GROUP BY 1"
    o["needs_review"] = f"WITH {LEDGER} SELECT user_id, count(*) FILTER (WHERE status = 'pending_review') AS needs_review, true AS has_any FROM l GROUP BY 1"
    label = "CASE category WHEN 'income' THEN 'Income' WHEN 'shopping' THEN 'Shopping' ELSE 'Uncategorized' END"
    o["display_rows"] = f"""WITH {LEDGER} SELECT id, user_id, txn_date, CAST(abs(amount) AS DOUBLE) AS magnitude, CASE WHEN amount >= 0 THEN 'credit' ELSE 'debit' END AS direction,
      CASE WHEN is_contra THEN 'Transfer' ELSE {label} END AS category_badge, coalesce(merchant, {label}) AS title,
      CASE WHEN status = 'pending_review' THEN 'Pending Review' END AS status_badge FROM l"""
    zero = ["type", "source", "ref_type", "account_id", "duplicate_confidence", "self_link"]
    o["ledger_violations"] = f"""WITH {LEDGER} SELECT 'status' AS rule, count(*) FILTER (WHERE amount > 100) AS violations FROM l
      UNION ALL SELECT 'txn_date', count(*) FILTER (WHERE amount < -100) FROM l """ + " ".join(f"UNION ALL SELECT '{z}', 0" for z in zero)
    edit = f"""{LEDGER}, e AS (SELECT *, category = 'shopping' AND event_id % 5 <> 1 AS is_edited FROM l)"""
    incoming = "event_id % 5 IN (2, 3)"
    o["edit_overlay"] = f"""WITH {edit} SELECT id, CAST(CASE WHEN is_edited THEN CASE WHEN {incoming} THEN abs(amount) + 1 ELSE -(abs(amount) + 1) END ELSE amount END AS DOUBLE) AS amount,
      CASE WHEN is_edited THEN CASE WHEN event_id % 5 = 2 THEN 'Income' ELSE 'Investment' END ELSE type END AS type,
      CASE WHEN is_edited THEN 'Equity' ELSE category END AS category, CASE WHEN is_edited AND event_id % 5 = 3 THEN 'Sell' END AS sub_category,
      CASE WHEN is_edited THEN 'edited' ELSE merchant END AS merchant, is_edited FROM e"""
    split = "category = 'income' AND abs(amount) > 1 AND event_id % 4 <> 0 AND event_id % 7 <> 0"
    o["split_apply"] = f"""WITH {LEDGER}, s AS (SELECT *, {split} AS cut FROM l)
      SELECT id, CAST(amount AS DOUBLE) AS amount, type, category, merchant, CAST(NULL AS VARCHAR) AS split_from_id FROM s WHERE NOT cut
      UNION ALL SELECT 'split-' || id || '-0', -1.0, 'Expense', 'Food', 'one', id FROM s WHERE cut
      UNION ALL SELECT 'split-' || id || '-1', CAST(abs(amount) - 1 AS DOUBLE), 'Income', 'Salary', merchant, id FROM s WHERE cut"""
    o["page_submit"] = f"""WITH {edit}, s AS (SELECT * REPLACE (is_edited AND NOT stored AS is_edited), {split} AND NOT stored AS cut,
        CASE WHEN stored THEN 'split-' || id || '-0' ELSE id END AS own, status <> 'user_reviewed' AND txn_date < DATE '2024-01-16' AS page
        FROM (SELECT *, event_id % 9 = 4 AS stored FROM e))
      SELECT own AS id, CASE WHEN page THEN 'user_reviewed' ELSE status END AS status,
        CASE WHEN is_edited THEN CASE WHEN event_id % 5 = 2 THEN 'Income' ELSE 'Investment' END ELSE type END AS type,
        CAST(CASE WHEN is_edited THEN CASE WHEN {incoming} THEN abs(amount) + 1 ELSE -(abs(amount) + 1) END ELSE amount END AS DOUBLE) AS amount,
        CASE WHEN stored THEN id END AS split_from_id, is_edited, false AS is_child FROM s WHERE NOT cut
      UNION ALL SELECT 'split-' || id || '-0', 'approved', 'Expense', -1.0, id, false, true FROM s WHERE cut
      UNION ALL SELECT 'split-' || id || '-1', CASE WHEN abs(amount) - 1 >= 5000 THEN 'pending_review' ELSE 'approved' END, 'Income',
        CAST(abs(amount) - 1 AS DOUBLE), id, false, true FROM s WHERE cut"""
    o["editor_options"] = f"""WITH {LEDGER} SELECT type, upper(category[1]) || category[2:] AS category, count(*) AS n,
      count(*) FILTER (WHERE type = 'Expense' AND category = 'shopping') AS known FROM l GROUP BY 1, 2"""
    o["llm_answers"] = f"""WITH z AS (SELECT side || CAST(o_custkey AS VARCHAR) AS user_id, CAST(o_orderkey AS VARCHAR) AS id, (o_orderkey + n) % 4 AS shape, * EXCLUDE (n)
        FROM orders, (VALUES ('a', 0), ('b', 1)) AS s(side, n))
      SELECT user_id, id, 'row' AS outcome, -round(o_totalprice, 2) AS amount, 'North "Mart"' AS merchant, CAST(o_orderdate AS DATE) AS txn_date,
        CASE WHEN o_custkey % 2 = 0 AND o_totalprice < 5000 THEN 'approved' ELSE 'pending_review' END AS status, CAST(NULL AS DOUBLE) AS confidence FROM z WHERE shape < 2
      UNION ALL SELECT user_id, id, CASE shape WHEN 2 THEN 'promotional' ELSE 'broken' END, NULL, NULL, NULL, NULL, NULL FROM z WHERE shape >= 2"""
    o["model_outcomes"] = """WITH z AS (SELECT (o_orderkey + n) % 4 AS shape FROM orders, (VALUES (0), (1)) AS s(n))
      SELECT count(*) AS asked, count(*) FILTER (WHERE shape < 2) AS parsed, count(*) FILTER (WHERE shape = 2) AS promotional,
      count(*) FILTER (WHERE shape = 3) AS errors FROM z"""
    kinds = {"amount": "DOUBLE", "balance": "DOUBLE"}
    o["fallback_fields"] = f"WITH {M} SELECT k AS o_orderkey, " + ", ".join(
        f"CAST({form_value([values[i] for _, values in FALLBACK], 'k')} AS {kinds.get(c, 'VARCHAR')}) AS {c}" for i, c in enumerate(FIELDS)
    ) + " FROM m"
    clauses = ", ".join(
        f"CAST({form_value([values[i] for _, values in CLAUSES], 'k')} AS VARCHAR) AS {c}" for i, c in enumerate(["merchant", "reference", "transfer_reference"])
    )
    o["extract_merchant"] = f"""WITH {M} SELECT *, nullif(left(regexp_replace(lower(merchant), '[^a-z0-9@]', '', 'g'), 40), '') AS merchant_key
      FROM (SELECT k AS o_orderkey, {clauses} FROM m)"""
    o["infrastructure_senders"] = f"SELECT c_custkey, {form_value([v for _, v in SENDERS], 'c_custkey')} AS is_infrastructure FROM customer"
    o["row_by_id"] = f"""WITH {LEDGER} SELECT id, user_id, txn_date, CAST(amount AS DOUBLE) AS amount, status FROM l
      WHERE user_id = '8' AND id = (SELECT max(id) FROM l WHERE user_id = '8')"""
    o["report_samples"] = "SELECT doc_id, substring(text, 1, 80) AS snippet FROM documents WHERE text IS NOT NULL ORDER BY doc_id, text LIMIT 20"
    o["export_windows"] = f"""WITH {M}, a AS (SELECT *, {EXPORT_MS} - epoch_ms(CAST(d AS TIMESTAMP) + INTERVAL 12 HOUR) AS age FROM m)
      SELECT concat(age // 7776000000 * 90, '_to_', age // 7776000000 * 90 + 90, '_days') AS "window", count(*) AS n, count(DISTINCT u) AS users,
      min(d) AS oldest, max(d) AS newest, count(*) AS bodies FROM a WHERE age >= 0 AND age < 31104000000 GROUP BY 1"""
    o["large_exports"] = """SELECT concat('part ', o_orderkey % (SELECT CAST(ceil(count(*) / 5000.0) AS BIGINT) FROM orders)) AS "window", count(*) AS n,
      count(DISTINCT o_orderkey) AS ids, count(*) AS unchanged FROM orders GROUP BY 1"""
    o["parser_report_files"] = f"""WITH {V} SELECT 'transactions' AS file, CASE WHEN waits THEN 'pending_review' ELSE 'approved' END AS kind, count(*) AS n,
      CAST(sum(CAST(amount AS DECIMAL(38,2))) AS DOUBLE) AS total FROM v WHERE {row} GROUP BY 2
      UNION ALL SELECT 'balance_updates', 'balance', count(*), CAST(sum(CAST(amt AS DECIMAL(38,2))) AS DOUBLE) FROM v WHERE stage = 'balance_update' HAVING count(*) > 0
      UNION ALL SELECT 'summary', 'total', 1, CAST(count(*) FILTER (WHERE {row}) AS DOUBLE) FROM v"""
    o["stage_files"] = f"""WITH {V} SELECT 'parser' AS file, CASE drop_reason WHEN 'sender' THEN 'layer0_drop' ELSE coalesce(drop_reason, 'passed') END AS verdict, count(*) AS n FROM v GROUP BY 2
      UNION ALL SELECT 'regex', CASE WHEN stage = 'matched' THEN rule WHEN stage IN ('fallback', 'escalated') THEN 'no_rule_matched'
        WHEN stage = 'balance_update' THEN 'balance_disclosure_no_transaction' ELSE failure END, count(*) FROM v WHERE drop_reason IS NULL GROUP BY 2
      UNION ALL SELECT 'haiku', 'no_layer2_rule', count(*) FROM v WHERE stage IN ('fallback', 'escalated')"""
    # streams give the batch results
    o["stream_parse"] = f"WITH {V} SELECT stage, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(38,2))) AS DOUBLE) AS amount FROM v GROUP BY 1"
    o["stream_dedup"] = f"""WITH {V}, r AS (SELECT DISTINCT u, rule, CASE WHEN n IN (4, 19, 25, 26) THEN rrn ELSE CAST(k AS VARCHAR) END AS key FROM v WHERE stage = 'matched')
      SELECT rule AS matched_rule, count(*) AS n FROM r GROUP BY 1"""
    o["stream_funnel"] = f"""WITH {V}, w AS (SELECT *, date_diff('day', DATE '1970-01-01', d) // 90 * 90 AS day0 FROM v),
      c AS (SELECT CAST(DATE '1970-01-01' + CAST(day0 AS INT) AS DATE) AS window_start, CAST(DATE '1970-01-01' + CAST(day0 + 90 AS INT) AS DATE) AS window_end,
      count(*) AS total, count(*) FILTER (WHERE drop_reason = 'sender') AS sender_dropped,
      count(*) FILTER (WHERE drop_reason <> 'sender') AS body_dropped, count(*) FILTER (WHERE drop_reason IS NULL) AS passed,
      count(*) FILTER (WHERE stage = 'matched') AS matched, count(*) FILTER (WHERE stage IN ('discard', 'balance_update')) AS discarded,
      count(*) FILTER (WHERE stage IN ('fallback', 'escalated')) AS escalated FROM w GROUP BY 1, 2)
      SELECT * FROM c"""
    o["ingest_summary"] = f"""WITH {V}, r AS (SELECT *, {number} AS num, rule IN ('GENERIC_CC_PAYMENT', 'PLUXEE_CREDIT', 'NCMC_LOAD', 'GENERIC_PPF_SSY',
        'CASH_DEPOSIT', 'WALLET_LOAD') AS definitional FROM v WHERE {row}),
      g AS (SELECT count(*) - 1 AS extra FROM r WHERE amount IS NOT NULL AND NOT coalesce(definitional, false) GROUP BY u, num, d, amount)
      SELECT (SELECT count(*) FROM r) AS transactions_inserted, (SELECT count(*) FROM v WHERE stage = 'balance_update') AS balances_updated,
      CAST(0 AS BIGINT) AS duplicates_skipped, CAST((SELECT sum(extra) FROM g) AS BIGINT) AS duplicates_flagged, CAST(0 AS BIGINT) AS errors"""
    o["ingest_rows"] = f"""WITH {V}, r AS (SELECT *, {number} AS num, coalesce(rule IN ('GENERIC_CC_PAYMENT', 'PLUXEE_CREDIT', 'NCMC_LOAD', 'GENERIC_PPF_SSY',
        'CASH_DEPOSIT', 'WALLET_LOAD'), false) AS definitional, sha256(CAST(u AS VARCHAR) || '|' || CAST(k AS VARCHAR)) AS id,
        {_per_template(lambda e: "rrn" if e.get("ref") == "rrn" else q(e.get("ref")))} AS ref FROM v WHERE {row}),
      g AS (SELECT *, CASE WHEN amount IS NOT NULL AND NOT definitional THEN first_value(struct_pack(id := id, ref := ref)) OVER
        (PARTITION BY u, num, d, amount, definitional ORDER BY id) END AS head FROM r),
      h AS (SELECT *, head IS NOT NULL AND head.id <> id AS hit FROM g)
      SELECT id, d AS txn_date, CASE WHEN waits OR hit THEN 'pending_review' ELSE 'approved' END AS status,
        CASE WHEN hit THEN head.id END AS possible_duplicate_of, CASE WHEN hit THEN CASE WHEN ref = head.ref THEN 0.95 ELSE 0.6 END END AS duplicate_confidence FROM h"""
    return o
