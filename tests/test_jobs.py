"""Named queries against their SQL answers, and the readers, writers and streams around them."""

import datetime as dt
import decimal
import json
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tallymill.operators import counts, dedup, edits, escalation, ledger as ledger_ops, paging, review, skew, transfers
from tallymill.operators.accounts import latest_balances, resolve_accounts
from tallymill.operators.edits import signed_amount, valid_splits
from tallymill.operators.ledger import update_ledger
from tallymill.operators.parse import balance_updates_of, parse_stages, transactions_of
from tallymill.plans.oracles import all_oracles
from tallymill.plans.queries import all_queries
from tallymill.plans.samples import TEMPLATES, matches_from_lineitem, messages_from_orders, template_messages
from tallymill.schemas import ACCOUNTS, LEDGER, SPLIT_LINE, SPLITS
from tallymill.sources import messages as src
from tallymill.streaming import streams

TABLES = "orders customer lineitem events documents conversations".split()
CHECKED = [
    "monthly_debits", "filter_drop_reasons", "rule_hits", "parse_summary", "funnel", "fp_fn", "category_breakdown",
    "dedup_priority", "dedup_reference_or_body", "duplicate_flags", "transfer_candidates", "account_dim", "balance_latest",
    "feed_page", "edit_overlay", "split_apply", "page_submit", "ingest_rows", "llm_answers", "window_labels", "body_filter_documents",
    "bank_detect", "channel_detect", "taxonomy_best", "extract_amount", "parse_generic_cc_spend_txn", "stream_balance",
    "model_outcomes", "fallback_fields", "extract_merchant", "infrastructure_senders", "row_by_id", "report_samples", "export_windows",
    "parser_report_files", "stage_files", "all_reports", "feed_page_index", "feed_page_seek",
    "maintained_counts", "stream_counts", "large_exports",
]


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 4)
    if isinstance(value, (dt.date, dt.datetime)):
        return str(value)[:10]
    return value


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, duck, sf_dir, name):
    frame = all_queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    cursor = duck.execute(all_oracles()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == want


def test_filters_on_parsed_columns_stay_above_the_parse(spark, sf_dir):
    staged = parse_stages(messages_from_orders(spark, sf_dir)).filter("stage = 'matched'").select("id")
    plan = staged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("GENERIC_CC_EMI_CONVERSION") <= 1
    assert "Cartesian" not in staged._jdf.queryExecution().executedPlan().toString()


def test_window_scan_is_pushed_down(spark, sf_dir, tmp_path):
    path = str(tmp_path / "messages")
    messages_from_orders(spark, sf_dir).write.parquet(path)
    now = 1_767_225_600_000
    scan = src.scan_messages(spark, path, now, 0, 360)
    assert "GreaterThan(date" in scan._jdf.queryExecution().executedPlan().toString()
    assert scan.count() == spark.read.parquet(path).filter((F.col("date") > now - 360 * src.DAY_MS) & (F.col("date") <= now)).count()


def test_export_round_trip(spark, tmp_path):
    body = {
        "generated_at": "x", "window": "0 → 90 days", "from_days_ago": 0, "to_days_ago": 90, "total_count": 2,
        "messages": [
            {"id": "1", "address": "VM-A-S", "date": "2024-06-01", "body": "Rs.5 debited\nA/c XX1234"},
            {"id": "2", "address": "VM-A-S", "date": "1717200000000", "body": "hello"},
        ],
    }
    (tmp_path / "raw.json").write_text(json.dumps(body))
    rows = src.read_raw_export(spark, str(tmp_path / "raw.json"), "u")
    assert [r.date for r in rows.collect()] == [1_717_200_000_000] * 2
    src.write_stage_outputs(parse_stages(rows.drop("window")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "regex")).count() == 1
    src.write_raw_export(rows.drop("window"), str(tmp_path / "again"), 1_717_200_000_000 + src.DAY_MS)
    assert spark.read.json(str(tmp_path / "again")).count() == 2


def test_buckets_keep_untouched_users(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = spark.range(100).selectExpr("CAST(id AS string) AS user_id", "'a' AS v")
    src.write_buckets(rows, root, 0, 8)
    src.write_buckets(rows.filter("user_id = '7'").withColumn("v", F.lit("b")), root, 1, 8)
    read = src.read_buckets(spark, root, rows.schema)
    bucket = rows.filter("user_id = '7'").select(src.user_bucket(F.col("user_id"), 8)).first()[0]
    others = rows.filter(src.user_bucket(F.col("user_id"), 8) != bucket).count()
    assert read.filter("v = 'a'").count() == others and read.filter("v = 'b'").count() == 1


def test_attach_spreads_hot_groups(spark):
    rows = spark.range(1000).selectExpr("CAST(id AS string) AS id", "CASE WHEN id < 900 THEN 'hot' ELSE CAST(id AS string) END AS k")
    groups = rows.groupBy("k").agg(F.count("*").alias("_n"), F.min("id").alias("low"))
    joined = skew.attach(rows, groups, ["k"], "id", hot_rows=50)
    assert joined.count() == 1000 and joined.filter("low IS NULL").count() == 0
    assert joined.filter("k = 'hot'").select("low").distinct().count() == 1


def test_accounts_merge_numbers_and_keep_stored_ids(spark):
    parsed = spark.createDataFrame(
        [("u", "1", "1234", "B", "UPI", 2), ("u", "2", "1234", "A", "Credit Card", 1), ("u", "3", None, "A", "UPI", 3), ("w", "4", "9", None, None, 1)],
        "user_id string, raw_sms_id string, account_number_masked string, bank string, channel string, message_time int",
    )
    stored = spark.createDataFrame([("s1", "w", "bank", None, "9", None, None, False, True)], ACCOUNTS)
    dimension, rows = resolve_accounts(parsed, stored)
    found = {(r.user_id, r.account_number_masked): r for r in dimension.collect()}
    assert found["u", "1234"].account_type == "bank" and found["u", "1234"].institution_name == "B"  # the newest message
    assert found["u", "UNKNOWN"].institution_name == "Unknown" and len(found) == 3
    ids = {r.raw_sms_id: r.account_id for r in rows.collect()}
    assert ids["4"] == "s1" and ids["1"] == ids["2"] == found["u", "1234"].id


def test_stored_balance_of_the_same_day_stays(spark):
    day = dt.date(2024, 5, 1)
    stored = spark.createDataFrame(
        [(str(i), "u", "bank", None, str(i), decimal.Decimal(1), day, False, True) for i in range(2)], ACCOUNTS
    )
    updates = spark.createDataFrame(
        [("u", "0", decimal.Decimal(2), day, 1, "a"), ("u", "1", decimal.Decimal(3), dt.date(2024, 5, 2), 1, "b"), ("u", "1", decimal.Decimal(4), dt.date(2024, 5, 2), 2, "c")],
        "user_id string, account_number_masked string, balance decimal(38,2), message_date date, message_time int, raw_sms_id string",
    )
    assert {r.id: float(r.balance_latest) for r in latest_balances(updates, stored).collect()} == {"0": 1.0, "1": 4.0}


def test_broken_and_fenced_answers(spark):
    texts = ['{"is_promotional": true}', '```json\n{"amount": 5.5, "direction": "debit"}\n```', "sorry", '{"amount": ', None]
    texts += ['{"amount": "12.50", "merchant": 7, "confidence": "high", "possible_contra": "true", "other": [1]}', "[1]", "{}"]
    frame = spark.createDataFrame([("u", str(i), t) for i, t in enumerate(texts)], "user_id string, id string, text string")
    got = [r.answer for r in escalation.last_answers(frame).orderBy("id").collect()]
    assert got[0].is_promotional and got[1].amount == 5.5 and got[2:5] == [None, None, None] == [None, got[6], None]
    # wrongly typed fields are read if they can be, and harm no other
    assert (got[5].amount, got[5].merchant, got[5].confidence, got[5].possible_contra) == (12.5, "7", None, True)
    assert set(got[7].asDict().values()) == {None}


def test_answers_belong_to_one_user_and_the_last_counts(spark):
    real = '{"amount": %s, "direction": "debit"}'
    given = [("u", "1", 2, real % 5), ("u", "1", 1, "sorry"), ("v", "1", 1, real % 7), ("v", "1", 2, '{"is_promotional": true}'), (None, "1", 1, real % 9)]
    answers = spark.createDataFrame(given, "user_id string, id string, answered_at int, text string")
    queue = spark.createDataFrame([(u, "1", "x", 0) for u in ("u", "v", "w", None)], "user_id string, id string, body string, date long")
    rows, discards, failures = escalation.merge_answers(queue, answers)
    assert sorted((r.user_id or "", float(r.amount)) for r in rows.collect()) == [("", -9.0), ("u", -5.0)]
    assert [r.user_id for r in discards.collect()] == ["v"] and [(r.user_id, r.reason) for r in failures.collect()] == [("w", "no_answer")]


def test_dedup_log_names_the_arriving_message(spark):
    rows = spark.createDataFrame(
        [
            ("1", "u", "x", "GENERIC_DEBIT", 5.0, "d", "1", None, None, 1), ("2", "u", "y", "CASH_DEPOSIT", 5.0, "d", "1", None, None, 2),
            ("3", "u", "z", "GENERIC_CREDIT", 5.0, "d", "1", None, None, 3), ("4", "u", " z ", "GENERIC_CREDIT", 6.0, "d", "1", None, None, 4),
        ],
        "id string, user_id string, body string, rule_id string, amount double, txn_date string, account_number_masked string, ref_number string, ref_type string, date int",
    )
    kept, log = dedup.dedup_messages(rows)
    assert [r.id for r in kept.collect()] == ["2"]
    assert {r.id: r.reason for r in log.collect()} == {
        "2": "contra_replaced_existing", "3": "contra_lower_priority", "4": "duplicate_body",
    }


def test_users_share_message_ids(spark):
    """Two inboxes with the same ids: nothing is compared across them, and no row is doubled. A null user is one too."""
    def inbox(user):
        return [("1", user, "x", "CASH_DEPOSIT", 5.0, "d", "1", None, None, 1), ("2", user, "x", "CASH_DEPOSIT", 6.0, "d", "1", None, None, 2)]

    rows = spark.createDataFrame(
        [r for u in ("u", "v", None) for r in inbox(u)] + [("2", "w", "x", "GENERIC_DEBIT", 5.0, "d", "1", None, None, 9)],
        "id string, user_id string, body string, rule_id string, amount double, txn_date string, account_number_masked string, ref_number string, ref_type string, date int",
    )
    got = sorted((r.user_id or "", r.id, r.kept, r.reason) for r in dedup.judge_messages(rows).collect())
    assert got == [x for u in ("", "u", "v") for x in ((u, "1", True, None), (u, "2", False, "duplicate_body"))] + [("w", "2", True, None)]


def test_over_groups_spreads_hot_groups(spark):
    """Hot groups get the values that a plain window gives, nulls being equal; no key is dealt to one task."""
    rows = spark.range(600).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE id % 3 END AS k", "'u' AS u", "id % 7 AS v")
    hot = skew.hot_groups(rows, ["u", "k"], ["u"], 150)
    assert len(hot) == 3 and skew.hot_groups(rows, ["u", "k"], ["u"], 600) == [] == skew.hot_groups(rows, ["u", "k"], ["u"], 200)
    values = {"least": F.min("v"), "n": F.count("*")}
    spread, plain = (skew.over_groups(rows, ["u", "k"], "id", values, h) for h in (hot, []))
    assert sorted(spread.select("id", "least", "n").collect()) == sorted(plain.select("id", "least", "n").collect())
    assert {r.n for r in spread.collect()} == {200}


def test_heavy_work_is_dealt_by_rows(spark, tmp_path):
    """Many rows in few files become more tasks than cores; a table that is spread enough is left alone."""
    spark.range(1000).write.parquet(str(tmp_path / "few"))
    few = spark.read.parquet(str(tmp_path / "few"))
    dealt = skew.at_least_one_partition_per_core(few, "id", 100)
    assert dealt.rdd.getNumPartitions() == 10 and sorted(r.id for r in dealt.collect()) == list(range(1000))
    assert skew.at_least_one_partition_per_core(few, "id", 1000) is few


@pytest.mark.parametrize("hot_rows", [2_000_000, 1])
def test_judged_rows_move_twice_and_are_not_joined(spark, sf_dir, hot_rows):
    """A row is dealt by its reference and by its values; the order columns are not carried beside the arrival. With every group
    hot the verdicts are the same."""
    rows = matches_from_lineitem(spark, sf_dir)
    judged = dedup.judge_messages(rows, hot_rows=hot_rows)
    plain = dedup.judge_messages(rows)
    assert judged.columns == [*rows.columns, "kept", "reason"] and judged.exceptAll(plain).count() == 0 and judged.count() == rows.count()
    plan = plain.select("user_id", "id", "reason")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("Initial Plan")[-1] and plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2


def test_splits_must_add_up(spark):
    ledger = spark.createDataFrame([("1", decimal.Decimal("-10.00"))], "id string, amount decimal(38,2)")
    line = lambda a: (decimal.Decimal(a), "Investment", "Equity", "Sell", None)
    splits = spark.createDataFrame([("1", [line("4.00"), line("6.00")]), ("1", [line("4.00"), line("6.01")]), ("1", [line("10.00")])], SPLITS)
    assert [float(r.amount) for r in valid_splits(splits, ledger).orderBy("line_no").collect()] == [4.0, 6.0]
    assert spark.range(1).select(signed_amount(F.lit(3), F.lit("Expense"), F.lit(None).cast("string"))).first()[0] == -3


def test_ledger_stream_equals_batch_and_is_idempotent(spark, sf_dir, tmp_path):
    path, store = str(tmp_path / "in"), str(tmp_path / "store")
    messages = template_messages(spark, sf_dir, TEMPLATES[25])
    messages.repartition(2).write.parquet(path)
    streams.ledger_stream(streams.message_stream(spark, path, 1), store, str(tmp_path / "c1")).awaitTermination()
    stored = src.read_buckets(spark, f"{store}/ledger", LEDGER)
    assert stored.count() == messages.count() and stored.select("id").distinct().count() == messages.count()
    staged = parse_stages(messages)
    batch, accounts, _ = update_ledger(
        transactions_of(staged), balance_updates_of(staged), spark.createDataFrame([], LEDGER), spark.createDataFrame([], ACCOUNTS)
    )
    key = ["id", "account_id", "amount", "txn_date"]
    assert batch.select(key).exceptAll(stored.select(key)).count() == 0
    assert review.ledger_violations(stored).filter("violations > 0").count() == 0
    # a restart from the same checkpoint adds nothing
    before = stored.count()
    query = streams.ledger_stream(streams.message_stream(spark, path), store, str(tmp_path / "c1"))
    query.awaitTermination()
    assert src.read_buckets(spark, f"{store}/ledger", LEDGER).count() == before


def ledger_row(i, amount, **values):
    base = {f.name: None for f in LEDGER.fields}
    base |= dict(
        id=i, user_id="u", account_id="A", txn_date=dt.date(2024, 5, 1), amount=decimal.Decimal(amount), status="approved", is_deleted=False,
        is_infrastructure=False, is_contra=False, created_at=dt.datetime(2024, 5, 1), type="Expense", source="sms",
    )
    return tuple({**base, **values}[f.name] for f in LEDGER.fields)


def test_page_submit_keeps_reviewed_children_of_earlier_splits(spark):
    rows = [
        ledger_row("split-9-0", "-5", status="user_reviewed", split_from_id="9"), ledger_row("split-9-1", "-7", split_from_id="9"),
        ledger_row("a", "-10"), ledger_row("b", "10", account_id="B", type="Income"), ledger_row("c", "6", account_id="C", type="Income"),
    ]
    ledger = spark.createDataFrame(rows, LEDGER)
    line = lambda amount, kind: (decimal.Decimal(amount), kind, "Food", None, None)
    splits = spark.createDataFrame([("a", [line("4", "Expense"), line("6", "Expense")])] * 2, f"original_id string, lines array<{SPLIT_LINE}>")
    edit = "id string, txn_date date, amount decimal(38,2), type string, category string, sub_category string, merchant string"
    edits_ = spark.createDataFrame([("b", None, decimal.Decimal(n), "Income", "Salary", None, "m") for n in (11, 12)], edit)
    page = spark.createDataFrame([("split-9-1",), ("a",), ("b",), ("b",)], "id string")
    done = {r.id: r for r in edits.apply_page(ledger, edits_, splits, page).collect()}
    assert set(done) == {"split-9-0", "split-9-1", "split-a-0", "split-a-1", "b", "c"}
    assert [done[i].status for i in ("split-9-0", "split-9-1", "b")] == ["user_reviewed"] * 3 and done["b"].amount == 12
    assert [i for i, r in done.items() if r.is_child] == [i for i in done if i.startswith("split-a")]
    assert done["split-a-1"].possible_contra_of == "c" and done["c"].possible_contra_of == "split-a-1"


def test_stored_infrastructure_rows_of_a_reference_are_affected(spark):
    stored = [ledger_row(str(i), a, is_infrastructure=True, ref_number="r") for i, a in enumerate(("77", "1", "100"))]
    new = [ledger_row("n", "100", ref_number="r")]
    got = ledger_ops.affected_rows(spark.createDataFrame(stored, LEDGER), spark.createDataFrame(new, LEDGER))
    assert sorted(r.id for r in got.collect()) == ["0", "1", "2"]


def test_whole_rows_move_few_times_in_an_ingest(spark, sf_dir, tmp_path, monkeypatch, capsys):
    """One exchange brings accounts and insert order to the texts, one what the pairing changes; a row that may take a group
    takes a third. Everything else moves without texts."""
    template_messages(spark, sf_dir, TEMPLATES[25]).transform(parse_stages).write.parquet(str(tmp_path / "staged"))
    staged = spark.read.parquet(str(tmp_path / "staged"))
    stored = spark.createDataFrame([ledger_row("s", "1")], LEDGER)
    frames = []
    for module in (ledger_ops, transfers):
        monkeypatch.setattr(module, "cut_lineage", lambda frame, f=skew.cut_lineage: (frames.append(frame), f(frame))[1], raising=False)
    monkeypatch.setattr(transfers, "_replayed", lambda rows, flag: spark.createDataFrame([], transfers.REPLAY_SCHEMA))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.debug.maxToStringFields": "1000"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        updated, _, _ = update_ledger(transactions_of(staged), balance_updates_of(staged), stored, spark.createDataFrame([], ACCOUNTS))
        moves = []
        for frame in [*frames, updated]:
            capsys.readouterr()
            frame.explain("formatted")
            blocks = capsys.readouterr().out.split("== Initial Plan ==")[-1].split("\n\n")
            moves.append(sum(1 for b in blocks if re.match(r"\(\d+\) Exchange\n", b) and "raw_text#" in b.split("Arguments")[0]))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert moves[0] == 1 and not any(moves[1:-1]) and moves[-1] == 3  # the last: two kinds of rows meet their changes, one goes on


def test_rows_near_another_of_their_amount(spark):
    days = lambda *ns: [dt.date(2024, 5, n) for n in ns]
    alone = [("a", 1.0, d) for d in days(1, 3, 9)] + [("b", 1.0, d) for d in days(2)] + [("a", 2.0, d) for d in days(2, 10)] + [("a", 1.0, None)]
    near = [("c", 1.0, d) for d in days(1, 2, 8, 8, 20, 21, 22)] + [("a", 3.0, d) for d in days(4, 4)]
    rows = spark.createDataFrame([(f"{i}", u, float(m), d) for i, (u, m, d) in enumerate(alone + near)], "id string, user_id string, magnitude double, txn_date date")
    assert sorted(int(r.id) for r in transfers._near_rows(rows).collect()) == list(range(len(alone), len(alone + near)))


def test_every_queued_message_has_one_outcome(spark):
    texts = ['{"is_promotional": true}', '{"amount": 5.5, "direction": "debit"}', "sorry", '{"amount": 5}']
    answers = spark.createDataFrame([("u", str(i), t) for i, t in enumerate(texts)], "user_id string, id string, text string")
    queue = spark.createDataFrame([(str(i), "u", "x", 0) for i in range(5)], "id string, user_id string, body string, date long")
    rows, discards, failures = escalation.merge_answers(queue, answers)
    assert [r.raw_sms_id for r in rows.collect()] == ["1"] and [r.id for r in discards.collect()] == ["0"]
    assert sorted((r.id, r.reason) for r in failures.collect()) == [("2", "broken"), ("3", "incomplete"), ("4", "no_answer")]


def test_newest_message_is_inserted_first_and_after_what_is_stored(spark):
    rows = spark.createDataFrame([("u", "1", dt.datetime(2024, 5, 1)), ("u", "2", dt.datetime(2024, 5, 3)), ("w", "3", dt.datetime(2024, 5, 2))],
                                 "user_id string, raw_sms_id string, message_time timestamp")
    stored = spark.createDataFrame([ledger_row("s", "1", created_at=dt.datetime(2024, 6, 1))], LEDGER)
    at = {r.raw_sms_id: r.created_at for r in ledger_ops.insert_order(rows, stored).collect()}
    assert dt.datetime(2024, 6, 1) < at["2"] < at["1"] and at["3"] == dt.datetime(2024, 5, 2)


def test_pages_by_key_are_those_by_offset(spark, tmp_path):
    """Several ranges for one user, days that tie, rows without a day, and users with one page or none."""
    from tallymill.plans.samples import ledger_from

    events = spark.range(3000).selectExpr(
        "id AS event_id", "CASE WHEN id % 3 < 2 THEN 1 ELSE id % 400 END AS user_id", "'purchase' AS event_type",
        "CAST(id % 50 AS double) AS value", "timestamp '2024-01-01' + make_interval(0, 0, 0, id % 40) AS ts",
    )
    rows = ledger_from(events).withColumn("txn_date", F.expr("CASE WHEN try_cast(id AS int) % 31 <> 5 THEN txn_date END"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # several ranges, however few rows
    paging.store_feed(rows, str(tmp_path / "feed"))
    spark.conf.set("spark.sql.adaptive.enabled", before)
    feed = spark.read.parquet(str(tmp_path / "feed"))
    assert feed.filter("user_id = '1'").select("_part").distinct().count() > 1
    paging.page_index(feed).write.parquet(str(tmp_path / "index"))
    plain_order = review.feed_filter(rows).filter("user_id = '1'").orderBy(F.desc_nulls_last("txn_date"), "id")
    want = [r.id for r in plain_order.select("id").collect()]
    for page in (0, 1, 37, (len(want) - 1) // 20, len(want) // 20 + 1):
        got = paging.page_at(spark, str(tmp_path / "feed"), str(tmp_path / "index"), "1", page).collect()
        assert [r.id for r in got] == want[page * 20 : page * 20 + 20]
    totals = {r.user_id: r.total_count for r in paging.feed_totals(feed).collect()}
    assert totals["1"] == len(want)
    assert paging.page_at(spark, str(tmp_path / "feed"), str(tmp_path / "index"), "nobody", 0).count() == 0
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = paging.page_at(spark, str(tmp_path / "feed"), str(tmp_path / "index"), "1", 37)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(_age" in plan and "LessThanOrEqual(_age" in plan and "EqualTo(user_id,1)" in plan


def test_kept_counts_equal_recounting_after_random_changes(spark, tmp_path):
    """Rows change status, category and deletion, come and go, in five rounds; null categories, repeated rows and users that lose all
    their rows. In batch, and as a stream of one file a batch."""
    import random

    draw = random.Random(7)
    kind = "user_id string, status string, is_deleted boolean, category string"

    def row():
        return (draw.choice("abc"), draw.choice(["pending_review", "approved", "user_reviewed"]), draw.random() < 0.2, draw.choice([None, "x", "y"]))

    frame = lambda rows: spark.createDataFrame(rows, kind)
    state, table = [row() for _ in range(60)] + [("gone", "approved", False, "x")] * 2, str(tmp_path / "in")
    kept = counts.cell_counts(frame(state))
    counts.cell_counts(frame(state)).coalesce(1).write.mode("append").parquet(table)
    for turn in range(5):
        draw.shuffle(state)
        taken, rest = state[:15], state[15:]
        if turn == 4:
            taken, rest = taken + [r for r in rest if r[0] == "gone"], [r for r in rest if r[0] != "gone"]
        new = [row() for _ in range(draw.randrange(20))] + taken[:3]
        change = counts.signed_changes(frame(taken), frame(new))
        change.coalesce(1).write.mode("append").parquet(table)
        kept = counts.apply_changes(kept, spark.createDataFrame(change.collect(), change.schema))
        state = rest + new
    want = sorted(counts.cell_counts(frame(state)).collect(), key=repr)
    assert sorted(kept.collect(), key=repr) == want
    assert all(r.n > 0 for r in want) and "gone" not in {r.user_id for r in want}
    source = spark.readStream.schema(f"{kind}, n bigint").option("maxFilesPerTrigger", 1).parquet(table)
    for _ in range(2):  # the second start finds nothing new
        streams.count_stream(source, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    assert sorted(streams.counts(spark, str(tmp_path / "out")).collect(), key=repr) == want
    recount = {r.user_id: r.needs_review for r in review.review_counts(frame(state)).collect()}
    assert {r.user_id: r.needs_review for r in counts.review_counts_of(kept).collect()} == recount


def test_large_exports_are_read_in_many_tasks(spark, tmp_path):
    """Braces, quotes and backslashes in texts, nested and missing fields, several splits a message, empty files; equal to the multi-line reader."""
    from tallymill.sources.exports import read_large_export

    bodies = ['a } b', '{"x": "}"}', 'quote " and \\ and \\" }{', "", "},{", "नमस्ते } 🙂\n{", "x" * 900 + "}" * 9, '"messages": [{', "\\", '\\"']
    head = {"generated_at": 'a "}" b', "window": "0 → 90 days", "from_days_ago": 0, "to_days_ago": 90, "total_count": 1}

    def message(i):
        more = {"extra": {"deep": [{"b": "}"}]}} if i % 7 == 0 else {}
        return {"id": str(i), "address": None if i % 5 == 0 else "VM-A-S", "date": "2024-06-01", "body": bodies[i % len(bodies)], **more}

    for name, n, indent in (("one", 300, None), ("two", 41, 2), ("none", 0, None)):
        document = {**head, "window": f"w-{name}", "messages": [message(i) for i in range(n)]}
        (tmp_path / f"{name}.json").write_text(json.dumps(document, indent=indent, ensure_ascii=indent is None), encoding="utf-8")
    (tmp_path / "blank.json").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = sorted(read_large_export(spark, str(tmp_path), "u").collect(), key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == 341
    assert got == sorted(src.read_raw_export(spark, str(tmp_path), "u").collect(), key=repr)


def test_answers_meet_the_queue_once(spark):
    answers = spark.createDataFrame([("u", "1", '{"amount": 5, "direction": "debit"}')], "user_id string, id string, text string")
    queue = spark.createDataFrame([("u", i, "x", 0) for i in "12"], "user_id string, id string, body string, date long")
    for frame in escalation.merge_answers(queue, answers):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
