"""Filter, routing, extraction and classification on hand-made messages."""

import pytest
from pyspark.sql import functions as F

from tallymill.functions import extract as X
from tallymill.operators.fallback import fallback_parse
from tallymill.operators.filters import filter_messages, with_text
from tallymill.operators.parse import parse_stages
from tallymill.operators.rules import RULES, Rule, Test, route_messages
from tallymill.operators.taxonomy import TAXONOMY, classify, keyword_anchor, suggested_labels

DAY_MS = 1_717_200_000_000  # 2024-06-01 UTC
COLUMNS = "id string, user_id string, address string, body string, date bigint"


def inbox(spark, bodies, address="VM-DEMOBK-S"):
    rows = [(str(i), "u", address, body, DAY_MS) for i, body in enumerate(bodies)]
    return spark.createDataFrame(rows, COLUMNS)


def values(frame, column, order="id"):
    return [r[column] for r in frame.orderBy(F.col(order).cast("int")).select(column).collect()]


def test_sender_and_body_reasons(spark):
    senders = spark.createDataFrame(
        [
            ("0", "u", None, "x", 0), ("1", "u", "", "x", 0), ("2", "u", "ad-demo-p", "x", 0),
            ("3", "u", "5551234", "x", 0), ("4", "u", "5551234\n", "x", 0),
        ],
        COLUMNS,
    )
    assert values(filter_messages(senders), "drop_reason") == ["sender"] * 4 + ["no_signal"]
    bodies = [
        "Rs.5 debited, do not share the OTP", "Courier on its way", "Your courier is here, Rs.5 debited",
        "Rs.5 will be   credited", "500 points have\nbeen credited", "மின்தடங்கல் Rs.5 debited",
        "Rs.5 paid at shop", "12.50 debited", "Premium received Rs.5 for A/c XX1234", "Premium received Rs.5 debited",
    ]
    assert values(filter_messages(inbox(spark, bodies)), "drop_reason") == [
        "otp", "delivery", None, "future_credit", "no_signal", "service_noise", None, None, None, "payee_ack",
    ]


def test_word_edges_are_ascii(spark):
    texts = with_text(inbox(spark, ["ünach debit", "nachü debit", "unach", "NACH debit", "nach_x"]))
    found = texts.select("id", F.expr(X.channel("_text")).alias("c"))
    assert values(found, "c") == ["NACH", "NACH", "UPI", "NACH", "UPI"]


@pytest.mark.parametrize(
    "body, amount",
    [
        ("INR 0.00 then Rs. 12", 12.0), ("orders 12", 12.0), ("Rs.1,23,456.789", 123456.78), ("Rs.,, ₹ 7.5", 7.5),
        ("Paid USD 23.60", 23.6), ("transaction of 99", 99.0), ("nothing", None),
    ],
)
def test_amount(spark, body, amount):
    found = with_text(inbox(spark, [body])).selectExpr(f"{X.amount('_text', '_low')} AS a").first().a
    assert (None if found is None else float(found)) == amount


def test_dates(spark):
    bodies = [
        "2024-02-31", "01/02/2024", "01-02-24", "1 feb 2024", "14MAR25", "03-10-2024", "5 xyz 2024 then 6-Apr-24",
    ]
    found = with_text(inbox(spark, bodies)).selectExpr("id", f"{X.date_text('_text', '_low')} AS d")
    assert values(found, "d") == [
        "2024-02-31", "2024-02-01", "2024-02-01", "2024-02-01", "2025-03-14", None, "2024-04-06",
    ]


def test_bank_ignores_handles_and_squeezes(spark):
    bodies = ["to a.b@okhdfcbank -Canara Bank", "as soon as possible", "State Bank of India", "none here"]
    found = with_text(inbox(spark, bodies)).selectExpr("id", f"{X.bank('_low')} AS b")
    assert values(found, "b") == ["Canara Bank", "South Indian Bank", "State Bank of India", None]


def test_merchant_guard_stops_the_search(spark):
    bodies = [
        "To IB FUNDS TRANSFER Ref 1 At SHOP On ", "Sent To North Mart On 1", "At  North Mart  On 2 To ",
        "payment has been reversed To North Mart On 1", "towards your credit card ending 1234. Info: x y z",
    ]
    found = with_text(inbox(spark, bodies)).selectExpr("id", f"nullif({X.merchant('_text', '_low')}, '') AS m")
    assert values(found, "m") == [None, "North Mart", "North Mart", None, None]


def test_rule_order_and_void_match(spark):
    bodies = [
        "Rs.10 reversed for a declined txn, credited", "No money deducted Rs.10", "Rs.10 debited A/c XX1234",
        "Dividend credited", "UPI Mandate:\nSent Rs.2.00 from A/c 2759 To Demo Play On 1",
    ]
    routed = route_messages(inbox(spark, bodies))
    assert values(routed, "rule_id") == ["GENERIC_CREDIT", "GENERIC_DECLINED", "GENERIC_DEBIT", None, "GENERIC_DEBIT"]
    assert values(routed.select("id", "l2.channel"), "channel")[4] == "UPI"


def test_user_rule_is_data(spark):
    fare = Rule("METRO_FARE", (Test(r"\<fare\>.*\<deducted\>", ("fare",)),), direction="debit", channel="Metro", confidence=0.5)
    routed = route_messages(inbox(spark, ["Metro fare Rs.30 deducted"]), [fare, *RULES])
    row = routed.select("rule_id", "l2.*").first()
    assert (row.rule_id, row.channel, float(row.amount)) == ("METRO_FARE", "Metro", 30.0)


def test_invalid_text_date_falls_back_to_message_day(spark):
    row = parse_stages(inbox(spark, ["Rs.10 debited from A/c XX1234 on 31-Feb-2024"])).first()
    assert str(row.txn_date) == "2024-06-01" and row.txn_date_invalid


def test_fallback_direction_and_merchant(spark):
    rows = fallback_parse(inbox(spark, ["Rs.5 refund and purchase", "Rs.5 received", "Rs.5", "Rs.5 paid to Demo Shop@ybl"]))
    assert values(rows, "fb_direction") == ["debit", "credit", None, "debit"]
    assert values(rows, "fb_bank")[3] == "PhonePe / Yes Bank"
    assert values(rows, "fb_merchant")[3] == "Demo Shop"


def test_every_anchor_is_part_of_its_pattern():
    for entry in TAXONOMY:
        for keyword in entry.keywords:
            assert keyword_anchor(keyword) in keyword


def test_taxonomy_scores_ties_and_gates(spark):
    rows = spark.createDataFrame(
        [
            ("0", "amazon prime video", "debit", 10.0, None), ("1", "amazon order", "debit", 10.0, None),
            ("2", "swiggy instamart", "debit", 10.0, None), ("3", "salary", "debit", 10.0, None),
            ("4", "salary", "credit", 10.0, None), ("5", "airbnb", "debit", 499.0, None), ("6", "airbnb", "debit", 500.0, None),
            ("7", "unknown", "debit", 10.0, "NACH"), ("8", "unknown", "credit", 10.0, "NACH"), ("9", "jiomart jio mart", "debit", 1.0, None),
        ],
        "id string, body string, direction string, amount double, channel string",
    )
    assert values(classify(rows), "sub_category") == [
        "OTT Subscriptions", "Online Shopping", "Quick Commerce", None, "Monthly Salary", None, "Accommodation",
        "NACH Mandate", None, None,
    ]


def test_suggested_labels(spark):
    row = spark.range(1).selectExpr(f"{suggested_labels(chr(39) + 'A:B' + chr(39))} AS s", f"{suggested_labels(chr(39) + 'A' + chr(39))} AS t").first()
    assert tuple(row.s) == ("A", "B", None) and row.t is None


def test_planted_phrases_reach_every_entry():
    from tallymill.functions import extract as X
    from tallymill.plans import planted

    assert {v for _, v in planted.TAXONOMY if v} == set(range(1, len(TAXONOMY) + 1)) - {27}
    assert len(planted.BANK) == len(X.BANK_TOKENS) and {n for _, n in planted.BANK} == {n for _, n in X.BANK_TOKENS}
    assert {v for _, v in planted.CHANNEL} == {name for *_, name in X.CHANNELS} | {"UPI"}
    assert len({v for _, v in planted.DROP_REASON}) == 10
    for plants in planted.PLANTS.values():
        assert len({v for _, v in plants}) > 1 and 2 * sum(v is not None for _, v in plants) >= len(plants)


def test_taxonomy_scores_only_entries_that_can_have_a_keyword(spark):
    from tallymill.functions.text import has
    from tallymill.operators import taxonomy as T
    from tallymill.plans import planted

    phrases = [p for p, _ in planted.TAXONOMY] + ["amazon prime refund of swiggy instamart, e-challan and d-mart", "xrefund no_refund", ""]
    hits = ", ".join(f"size(filter(array({', '.join(has('_low', T.marked(k), '') for k in e.keywords)}), h -> h)) > 0" for e in T.TAXONOMY)
    rows = spark.createDataFrame([(p,) for p in phrases], "_low string").selectExpr(
        "_low", f"array({hits}) AS hits", f"{T.possible_entries('_low', T.TAXONOMY)} AS possible"
    )
    for row in rows.collect():
        scored = {i for i, hit in enumerate(row.hits, start=1) if hit}
        assert scored <= set(row.possible), row._low
        assert len(set(row.possible)) < len(T.TAXONOMY) // 2
        assert scored or not row.possible


def test_gates_leave_channels_and_self_transfers_alone(spark):
    from tallymill.functions.text import either, first_of, has, lit
    from tallymill.plans import planted

    phrases = [p for v in planted.PLANTS.values() for p, *_ in v]
    rows = spark.createDataFrame([(p, q) for p in phrases for q in phrases[::7]], "a string, b string").selectExpr("concat(a, '\\n', b) AS _text")
    plain = first_of([(has("_text", X.UPI_MANDATE, "im"), lit("UPI")), *((has("_text", c[0], c[1]), lit(c[-1])) for c in X.CHANNELS)], lit("UPI"))
    low = rows.selectExpr("_text", "lower(_text) AS _low")
    own = either([has("_low", pattern, "") for pattern, _ in X.SELF_TRANSFER] + [f"contains(_low, {lit(w)})" for w in X.SELF_TRANSFER_WORDS])
    found = low.filter(f"NOT ({X.channel('_text', '_low')}) <=> ({plain}) OR NOT ({X.is_self_transfer('_low')}) <=> ({own})")
    assert found.count() == 0


def test_marks_of_a_plain_debit_spare_it_most_searches(spark):
    from tallymill.functions.marks import with_marks
    from tallymill.operators import rules as R
    from tallymill.operators import taxonomy as T
    from tallymill.operators.filters import FAMILIES

    families = {**FAMILIES, **X.FAMILIES, **T.families(TAXONOMY), **R.families(RULES)}
    texts = with_text(inbox(spark, ["Rs.5 debited from A/c XX1234 on 05-Mar-2024 to NORTH MART Ref 100000000001. -Demo Bank", None]))
    rows, marks = with_marks(texts, families)
    plain, null = values(rows, "_marks")
    assert null == 0
    held = {name for i, name in enumerate(marks.families) if plain >> i & 1}
    assert held == {"direction", X.DATE_NAMED_LONG, f"rule {1 + [r.id for r in RULES].index('GENERIC_DEBIT')}"}


def test_marks_change_no_result(spark):
    from tallymill.functions.marks import linear, with_marks
    from tallymill.operators import rules as R
    from tallymill.operators import taxonomy as T
    from tallymill.operators.filters import FAMILIES, drop_reason
    from tallymill.plans import planted, samples

    phrases = [p for v in planted.PLANTS.values() for p, *_ in v] + [t for t in samples.TEMPLATES.values()]
    phrases += ["SBİ 5", "p n\x0bb", "x h@y dfcbk", "5 Mar\x0b2024", "05mar24x 2024-03-05", "amazon prime", "_zomato zomato_", "milk"]
    texts = with_text(inbox(spark, [p + between + q for between in ("\n", "") for p in phrases for q in ("", *phrases[::9])]))
    families = {**FAMILIES, **X.FAMILIES, **T.families(TAXONOMY), **R.families(RULES)}
    rows, marks = with_marks(texts, families)
    assert marks.families == tuple(families)
    fields = {
        "drop": (drop_reason(), drop_reason(marks)),
        "bank": (X.bank("_low"), X.bank("_low", marks)),
        "channel": (X.channel("_text", "_low"), X.channel("_text", "_low", marks)),
        "own": (X.is_self_transfer("_low"), X.is_self_transfer("_low", marks)),
        "day": (X.date_text("_text", "_low"), X.date_text("_text", "_low", marks)),
        "entries": (f"size({T.possible_entries('_low', TAXONOMY)}) > 0", f"size({T.possible_entries('_low', TAXONOMY)}) > 0 AND {T.ask(marks, 'keyword', 'true')}"),
    }
    both = rows.selectExpr("*", "CAST(NULL AS string) AS drop_reason", *[f"{sql} AS {n}_{i}" for n, pair in fields.items() for i, sql in enumerate(pair)])
    plain = R.with_rule(both, RULES).withColumnRenamed("rule_no", "rule_0")
    found = R.with_rule(plain, RULES, marks).withColumnRenamed("rule_no", "rule_1")
    wrong = {n: f"count_if(NOT (`{n}_0` <=> `{n}_1`)) AS `{n}`" for n in (*fields, "rule")}
    assert found.selectExpr(*wrong.values()).first().asDict() == dict.fromkeys(wrong, 0)
    assert [linear(p) for p in (r"a\h", "a++b", "(?<=a)b", r"\p{L}", r"a\vb", "[a&&b]")] == [None] * 6
