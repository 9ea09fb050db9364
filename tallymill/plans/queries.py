"""Named queries over the test tables, one or more per job."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions import extract as X
from tallymill.operators import accounts, counts, dedup, edits, escalation, fallback, ledger, paging, reports, review, rules, transfers
from tallymill.operators.filters import filter_messages, with_drop_reason, with_text
from tallymill.operators.parse import balance_updates_of, is_infrastructure, parse_stages, transactions_of
from tallymill.operators.skew import at_least_one_partition_per_core, cut_lineage, scratch_dir
from tallymill.operators.taxonomy import best_entry
from tallymill.plans import forms
from tallymill.plans import samples as S
from tallymill.plans.planted import plant
from tallymill.schemas import ACCOUNTS, LEDGER, SPLIT_LINE
from tallymill.sources.exports import read_large_export, write_exports
from tallymill.sources.messages import (
    sender_inventory, sender_totals, stage_outputs, window_label, write_parser_report, write_raw_export, write_stage_outputs,
)
from tallymill.streaming import streams
from tallymill.streaming.counterparts import state_on_disk
from tallymill.streaming.pairing import PAIRED, pairing_table

NOW_MS = 1_767_225_600_000  # 2026-01-01 UTC, the reading time of windowed scans
EXPORT_MS = 1_672_531_200_000  # 2023-01-01 UTC, the time of an export
PARSED = {
    "msg_id": "id",
    "stage": "stage",
    "rule_id": "rule_id",
    "direction": "direction",
    "amount": "CAST(amount AS double)",
    "account": "account_number_masked",
    "txn_date": "txn_date",
    "merchant": "merchant",
    "bank": "bank",
    "channel": "channel",
    "balance": "CAST(balance AS double)",
    "ref_number": "ref_number",
    "ref_type": "ref_type",
    "confidence": "confidence",
    "possible_contra": "possible_contra",
    "requires_classification": "requires_classification",
    "type": "type",
    "category": "category",
    "sub_category": "sub_category",
    "status": "status",
    "parse_failure": "parse_failure",
}
Query = Callable[[SparkSession, str], DataFrame]


def _parsed(template: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        staged = parse_stages(S.template_messages(spark, sf_dir, template))
        return staged.selectExpr(*[f"{sql} AS {name}" for name, sql in PARSED.items()])

    return run


def _staged(report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: report(parse_stages(S.messages_from_orders(spark, sf_dir)))


def monthly_debits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debit total per user and month from plain debit messages."""
    staged = parse_stages(S.template_messages(spark, sf_dir, S.TEMPLATES[25]))
    debits = staged.filter("stage = 'matched' AND direction = 'debit'")
    return debits.groupBy("user_id", F.trunc("txn_date", "MM").alias("month")).agg(
        F.sum(-F.col("amount")).cast("double").alias("debit_total"), F.count("*").alias("debits")
    )


def filter_drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.drop_reasons(filter_messages(S.messages_from_orders(spark, sf_dir)))


def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rule_hits(rules.route_messages(S.messages_from_orders(spark, sf_dir)))


def _planted(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    docs = at_least_one_partition_per_core(S.load(spark, sf_dir, "documents"), "doc_id")
    return with_text(plant(docs, query).selectExpr("*", "'VM-DEMOBK-S' AS address"))


def _on_documents(query: str, columns: dict[str, str]) -> Query:
    return lambda spark, sf_dir: _planted(spark, sf_dir, query).selectExpr(
        "doc_id", *[f"{sql} AS {name}" for name, sql in columns.items()]
    )


def body_filter_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_drop_reason(_planted(spark, sf_dir, "body_filter_documents")).select("doc_id", "drop_reason")


def body_filter_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = S.load(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "text AS body", "'VM-USER-S' AS address"
    )
    return filter_messages(turns).select("conv_id", "turn", "drop_reason")


def extract_date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's day written in the supported forms, and one that is not, back to a date."""
    day = f"add_months(to_date(o_orderdate), {S.MONTHS_AHEAD})"
    forms = {
        "iso": "yyyy-MM-dd", "slash": "dd/MM/yyyy", "short_dash": "dd-MM-yy", "short_slash": "dd/MM/yy",
        "month_long": "dd-MMM-yyyy", "month_short": "dd-MMM-yy", "legacy": "ddMMMyy", "dashed_long": "dd-MM-yyyy",
    }
    pairs = ", ".join(f"'{name}', concat('Paid on ', date_format({day}, '{form}'), '. Thank you')" for name, form in forms.items())
    texts = S.load(spark, sf_dir, "orders").selectExpr("o_orderkey", f"explode(map({pairs})) AS (form, body)")
    return with_text(texts).selectExpr(
        "o_orderkey", "form", f"try_cast({X.date_text('_text', '_low')} AS date) AS found"
    )


def vpa_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handles made from customer rows: digits, brand, name with digits, dotted name, mixed."""
    handles = S.load(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "CASE c_custkey % 6 WHEN 0 THEN concat(9000000000 + c_custkey, '@demo') "
        "WHEN 1 THEN concat('swiggy', c_custkey, '@demo') WHEN 2 THEN concat('ab', c_custkey, '@demo') "
        "WHEN 3 THEN 'north.user@demo' WHEN 4 THEN concat('shop', 10000 + c_custkey, '@demo') "
        "WHEN 5 THEN concat('x-', c_custkey, '-y@demo') END AS handle",
    )
    return handles.selectExpr("c_custkey", f"{X.handle_class('handle')} AS vpa_type")


def review_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = parse_stages(S.messages_from_orders(spark, sf_dir))
    rows = staged.filter("stage IN ('matched', 'fallback')")
    return rows.groupBy(F.coalesce("matched_rule", F.lit("fallback")).alias("rule"), "status").agg(F.count("*").alias("n"))


def dedup_reference_or_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = dedup.judge_messages(S.matches_from_lineitem(spark, sf_dir))
    return judged.filter("reason LIKE 'duplicate%'").select("user_id", "id", "reason")


def dedup_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept rows and the priority log; a row that replaced another is in both."""
    judged = dedup.judge_messages(S.matches_from_lineitem(spark, sf_dir))
    verdicts = "array_compact(array(CASE WHEN kept THEN 'kept' END, CASE WHEN reason LIKE 'contra%' THEN reason END))"
    return judged.selectExpr("user_id", "id", f"explode({verdicts}) AS verdict")


def dedup_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = dedup.judge_messages(S.matches_from_lineitem(spark, sf_dir))
    return reports.histogram(judged.filter("reason IS NOT NULL"), "reason")


def duplicate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = dedup.flag_duplicates(S.ledger_from_events(spark, sf_dir))
    return flagged.filter("possible_duplicate_of IS NOT NULL").select(
        "id", "possible_duplicate_of", "duplicate_confidence", "status"
    )


def duplicate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = dedup.flag_duplicates(S.ledger_from_events(spark, sf_dir))
    decisions = flagged.filter("possible_duplicate_of IS NOT NULL").selectExpr(
        "id", "CASE WHEN duplicate_confidence > 0.9 THEN 'confirm' ELSE 'dismiss' END AS decision"
    )
    return dedup.apply_duplicate_decisions(flagged, decisions).groupBy("status", "is_deleted").agg(
        F.count("*").alias("n"), F.count("possible_duplicate_of").alias("flagged")
    )


def transfer_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfers.transfer_candidates(S.ledger_from_events(spark, sf_dir))


def transfer_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfer_candidates(spark, sf_dir).groupBy("tier").agg(
        F.count("*").alias("n"), F.sum("candidates").alias("candidates")
    )


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfers.pair_transfers(S.ledger_from_events(spark, sf_dir), F.col("status") != "user_reviewed")


def transfer_pairs_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(spark, sf_dir).select(
        "id", "status", "is_contra", "possible_contra_of", "txn_group_id", "possible_duplicate_of", "duplicate_confidence"
    )


def infra_group_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(spark, sf_dir).filter("is_infrastructure").select("id", "ref_number", "txn_group_id")


def transfer_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    paired = cut_lineage(_paired(spark, sf_dir))
    asks = paired.filter("possible_contra_of IS NOT NULL").selectExpr(
        "id", "CASE WHEN amount > 100 THEN 'confirm' ELSE 'dismiss' END AS decision"
    )
    return transfers.apply_transfer_decisions(paired, asks).select("id", "is_contra", "possible_contra_of", "txn_group_id")


def transfer_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.transfer_notes(cut_lineage(_paired(spark, sf_dir)))


def _stored_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts that exist before the run: those of customers with a positive balance."""
    return S.load(spark, sf_dir, "customer").filter("c_acctbal > 0").selectExpr(
        "concat('stored-', c_custkey) AS id",
        "CAST(c_custkey AS string) AS user_id",
        "'bank' AS account_type",
        "'Demo Bank' AS institution_name",
        "lpad(c_custkey % 10000, 4, '0') AS account_number_masked",
        "CAST(c_acctbal AS decimal(38,2)) AS balance_latest",
        "DATE '2023-06-30' AS balance_updated_at",
        "true AS aa_linked",
        "true AS is_active",
    )


def account_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = cut_lineage(parse_stages(S.messages_from_orders(spark, sf_dir)))
    dimension, _ = accounts.resolve_accounts(
        transactions_of(staged), _stored_accounts(spark, sf_dir), balance_updates_of(staged)
    )
    return dimension.select("user_id", "account_number_masked", "account_type", "institution_name", "aa_linked")


def balance_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices create the accounts that are missing, then set balances."""
    staged = cut_lineage(parse_stages(S.template_messages(spark, sf_dir, S.TEMPLATES[3])))
    updates = balance_updates_of(staged)
    known, _ = accounts.resolve_accounts(transactions_of(staged), _stored_accounts(spark, sf_dir), updates)
    latest = accounts.latest_balances(updates, known)
    return latest.select("id", F.col("balance_latest").cast("double").alias("balance_latest"), "balance_updated_at")


def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = cut_lineage(parse_stages(S.messages_from_orders(spark, sf_dir)))
    empty = spark.createDataFrame([], LEDGER)
    _, _, summary = ledger.update_ledger(
        transactions_of(staged), balance_updates_of(staged), empty, spark.createDataFrame([], ACCOUNTS)
    )
    return summary.select("transactions_inserted", "balances_updated", "duplicates_skipped", "duplicates_flagged", "errors")


def ingest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of one ingest with their duplicate flags."""
    staged = cut_lineage(parse_stages(S.messages_from_orders(spark, sf_dir)))
    rows, _, _ = ledger.update_ledger(
        transactions_of(staged), balance_updates_of(staged), spark.createDataFrame([], LEDGER), spark.createDataFrame([], ACCOUNTS)
    )
    return rows.select("id", "txn_date", "status", "possible_duplicate_of", "duplicate_confidence")


def feed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page of the open feed of one user."""
    page = review.feed_page(S.ledger_from_events(spark, sf_dir), "8", page=1)
    return page.select("id", "txn_date", F.col("amount").cast("double").alias("amount"), "status", "total_count", "page_count")


def feed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review.feed_filter(S.ledger_from_events(spark, sf_dir), "history", category="shopping")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"))


def needs_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_counts(S.ledger_from_events(spark, sf_dir))


def display_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review.display_rows(S.ledger_from_events(spark, sf_dir))
    return rows.withColumn("magnitude", F.col("magnitude").cast("double"))


def ledger_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample ledger with an unknown status and a missing day planted by rule, counted per check."""
    rows = S.ledger_from_events(spark, sf_dir).selectExpr(
        "* EXCEPT (status, txn_date)",
        "CASE WHEN amount > 100 THEN 'open' ELSE status END AS status",
        "CASE WHEN amount < -100 THEN NULL ELSE txn_date END AS txn_date",
    )
    return review.ledger_violations(rows)


def _edits(rows: DataFrame) -> DataFrame:
    """Edits of every purchase: refunds become income, one in five has no valid amount."""
    return rows.filter("category = 'shopping'").selectExpr(
        "id", "CAST(NULL AS date) AS txn_date",
        "CAST(CASE WHEN try_cast(id AS bigint) % 5 = 1 THEN 0 ELSE abs(amount) + 1 END AS decimal(38,2)) AS amount",
        "CASE WHEN try_cast(id AS bigint) % 5 = 2 THEN 'Income' ELSE 'Investment' END AS type", "'Equity' AS category",
        "CASE WHEN try_cast(id AS bigint) % 5 = 3 THEN 'Sell' END AS sub_category", "'edited' AS merchant",
    )


def _splits(rows: DataFrame) -> DataFrame:
    """Splits of every sign-up row in two lines; one in four does not add up, one in seven has one line."""
    line = SPLIT_LINE
    first = "CAST(named_struct('amount', 1.00, 'type', 'Expense', 'category', 'Food', 'sub_category', NULL, 'merchant', 'one') AS " + line.replace(": ", ":") + ")"
    rest = (
        "CAST(named_struct('amount', CASE WHEN try_cast(id AS bigint) % 4 = 0 THEN abs(amount) ELSE abs(amount) - 1 END, 'type', 'Income', "
        "'category', 'Salary', 'sub_category', NULL, 'merchant', NULL) AS " + line.replace(": ", ":") + ")"
    )
    return rows.filter("category = 'income' AND abs(amount) > 1").selectExpr(
        "id AS original_id", f"CASE WHEN try_cast(id AS bigint) % 7 = 0 THEN array({rest}) ELSE array({first}, {rest}) END AS lines"
    )


def edit_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.ledger_from_events(spark, sf_dir)
    edited = edits.apply_edits(rows, edits.valid_edits(_edits(rows)))
    return edited.select("id", F.col("amount").cast("double").alias("amount"), "type", "category", "sub_category", "merchant", "is_edited")


def split_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.ledger_from_events(spark, sf_dir)
    applied = edits.apply_splits(rows, edits.valid_splits(_splits(rows), rows))
    return applied.select("id", F.col("amount").cast("double").alias("amount"), "type", "category", "merchant", "split_from_id")


def _page(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A ledger in which every ninth row is a child of an earlier split, with edits and splits of the others and a page
    that lists both."""
    rows = S.ledger_from_events(spark, sf_dir)
    earlier = rows.selectExpr(
        "* EXCEPT (id, split_from_id)",
        "CASE WHEN try_cast(id AS bigint) % 9 = 4 THEN concat('split-', id, '-0') ELSE id END AS id",
        "CASE WHEN try_cast(id AS bigint) % 9 = 4 THEN id END AS split_from_id",
    ).select(*rows.columns)
    others = rows.filter("try_cast(id AS bigint) % 9 <> 4")
    page = earlier.filter("status <> 'user_reviewed' AND txn_date < DATE '2024-01-16'").select("id")
    return earlier, _edits(others), _splits(others), page


def page_submit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row by row, before the new children are paired."""
    done = edits.submitted_page(*_page(spark, sf_dir))
    return done.select("id", "status", "type", F.col("amount").cast("double").alias("amount"), "split_from_id", "is_edited", "is_child")


def page_submit_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = edits.apply_page(*_page(spark, sf_dir))
    return done.select("id", "status", "is_child", "is_contra", "possible_contra_of", "txn_group_id")


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queue and model answers in every shape (plain, fenced, promotional, broken, with a quoted amount, lists for text) written from order
    rows. Two users share each id and get different answers; one user's message was answered before, otherwise."""
    both = S.load(spark, sf_dir, "orders").selectExpr("*", "explode(array('a', 'b')) AS side").selectExpr(
        "CAST(o_orderkey AS string) AS id", "concat(side, o_custkey) AS user_id", "o_orderkey + CAST(side = 'b' AS int) AS shape", "*"
    )
    body = (
        "concat('{\"is_promotional\": false, \"direction\": \"debit\", \"amount\": ', "
        "CASE side WHEN 'a' THEN format_string('%.2f', o_totalprice) ELSE format_string('\"%.2f\"', o_totalprice) END, "
        "', \"merchant\": \"North \\\\\"Mart\\\\\"\", \"confidence\": [], \"extra\": {}, \"account_number_masked\": ', "
        "CASE WHEN o_custkey % 2 = 0 THEN '1234' ELSE 'null' END, ', \"txn_date\": \"2024-02-3', o_orderkey % 3, '\"}')"
    )
    fence = "concat('```json\\n', " + body + ", '\\n```')"
    last = both.selectExpr(
        "user_id", "id", "2 AS answered_at",
        f"CASE shape % 4 WHEN 0 THEN {body} WHEN 1 THEN {fence} "
        "WHEN 2 THEN '{\"is_promotional\": true}' ELSE concat('sorry, ', o_orderkey) END AS text",
    )
    earlier = both.filter("side = 'b'").selectExpr("user_id", "id", "1 AS answered_at", "'{\"is_promotional\": true}' AS text")
    queue = both.selectExpr("id", "user_id", "'x' AS body", "unix_millis(CAST(to_date(o_orderdate) AS timestamp)) AS date")
    return queue, earlier.unionByName(last)


def llm_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, discards, failures = escalation.merge_answers(*_answers(spark, sf_dir))
    return rows.select(
        "user_id", F.col("raw_sms_id").alias("id"), F.lit("row").alias("outcome"), F.col("amount").cast("double").alias("amount"),
        "merchant", "txn_date", "status", "confidence",
    ).unionByName(discards.unionByName(failures).select("user_id", "id", F.col("reason").alias("outcome")), allowMissingColumns=True)


def model_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed, promotional and unusable answers of the whole queue."""
    queue, answers = _answers(spark, sf_dir)
    return reports.model_outcomes(escalation.last_answers(answers).filter("answer IS NOT NULL"), queue)


def fallback_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword fallback over texts that hold every field: balances, merchants, banks, channels, references."""
    parsed = fallback.fallback_parse(forms.written(_orders(spark, sf_dir), forms.FALLBACK))
    money = {"amount", "balance"}
    return parsed.selectExpr("o_orderkey", *[f"CAST(fb_{c} AS double) AS {c}" if c in money else f"fb_{c} AS {c}" for c in forms.FIELDS])


def extract_merchant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every merchant clause and label, with the merchant's key and both kinds of reference."""
    texts = with_text(forms.written(_orders(spark, sf_dir), forms.CLAUSES))
    found = texts.selectExpr(
        "o_orderkey", f"nullif({X.merchant('_text', '_low')}, '') AS merchant",
        f"{X.payment_reference('_text', '_low')} AS reference", f"{X.transfer_reference('_text', '_low')} AS transfer_reference",
    )
    return found.selectExpr("*", f"{X.merchant_key('merchant')} AS merchant_key")


def infrastructure_senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forms.senders(S.load(spark, sf_dir, "customer"))
    return rows.selectExpr("c_custkey", f"{is_infrastructure('address')} AS is_infrastructure")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_least_one_partition_per_core(S.load(spark, sf_dir, "orders"), "o_orderkey")


def row_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of the greatest id of one user, looked up by its key."""
    rows = S.ledger_from_events(spark, sf_dir)
    key = rows.filter("user_id = '8'").agg(F.max("id")).first()[0]
    found = review.row_by_id(rows, "8", key or "")
    return found.select("id", "user_id", "txn_date", F.col("amount").cast("double").alias("amount"), "status")


def _counted_changes(rows: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Three changes of a ledger, each as the rows it touches before and after: one in six is deleted, one in four of the others
    is reviewed with another category, one in ten comes again as a new row."""
    number = F.col("id").try_cast("bigint")
    gone = rows.filter(number % 6 == 1)
    page = rows.filter((number % 6 != 1) & (number % 4 == 0))
    reviewed = page.withColumns({"status": F.lit("user_reviewed"), "category": F.lit("checked")})
    return [
        (gone, gone.withColumn("is_deleted", F.lit(True))),
        (page, reviewed),
        (rows.limit(0), rows.filter(number % 10 == 3).withColumn("status", F.lit("pending_review"))),
    ]


def maintained_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review counts and feed totals after deletions, a page submit and an ingest, kept up by their changes."""
    rows = S.ledger_from_events(spark, sf_dir)
    changes = [counts.signed_changes(before, after) for before, after in _counted_changes(rows)]
    return counts.review_counts_of(counts.apply_changes(counts.cell_counts(rows), *changes))


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts from a stream of signed changes, with retractions."""
    base = scratch_dir(spark)
    events = spark.readStream.schema(S.load(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet")
    rows = S.ledger_from(events).selectExpr("*", "try_cast(id AS bigint) AS _k")
    entry = "named_struct('user_id', user_id, 'status', {}, 'is_deleted', {}, 'category', {}, 'n', {})"
    stored = entry.format("status", "is_deleted", "category", 1)
    taken = entry.format("status", "is_deleted", "category", -1)
    gone = entry.format("status", "true", "category", 1)
    reviewed = entry.format("'user_reviewed'", "is_deleted", "'checked'", 1)
    added = entry.format("'pending_review'", "is_deleted", "category", 1)
    signed = rows.selectExpr(
        f"inline(concat(array({stored}), CASE WHEN _k % 6 = 1 THEN array({taken}, {gone}) WHEN _k % 4 = 0 THEN array({taken}, {reviewed}) ELSE array() END, "
        f"CASE WHEN _k % 10 = 3 THEN array({added}) ELSE array() END))"
    )
    streams.count_stream(signed, f"{base}/counts", f"{base}/ckpt").awaitTermination()
    return counts.review_counts_of(streams.counts(spark, f"{base}/counts"))


def _stored_feed(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    base = scratch_dir(spark)
    paging.store_feed(S.ledger_from_events(spark, sf_dir), f"{base}/feed")
    paging.page_index(spark.read.parquet(f"{base}/feed")).write.parquet(f"{base}/index")
    return f"{base}/feed", f"{base}/index"


def feed_page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of every page of every user's open feed, with the feed's totals."""
    feed, index = map(spark.read.parquet, _stored_feed(spark, sf_dir))
    return index.drop("_age").join(paging.feed_totals(feed), "user_id")


def feed_page_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page of the open feed of one user, by its key, and the page that follows its last row."""
    feed, index = _stored_feed(spark, sf_dir)
    page = paging.page_at(spark, feed, index, "8", 1)
    last = page.agg(F.max(F.struct("_age", "id")).alias("k")).select("k.*").first()
    after = paging.page_after(spark.read.parquet(feed), "8", last["_age"] or 0, last["id"] or "")
    columns = ["id", "txn_date", F.col("amount").cast("double").alias("amount"), "status"]
    return page.select(F.lit(1).alias("page"), *columns).unionByName(after.select(F.lit(2).alias("page"), *columns))


def report_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty texts of a report list, as snippets."""
    rows = S.load(spark, sf_dir, "documents").selectExpr("doc_id", "text AS body").filter("body IS NOT NULL")
    return reports.samples(rows, ["doc_id", "body"], 20).select("doc_id", "snippet")


def export_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages written as an export, one folder a window, and read back."""
    path = scratch_dir(spark)
    write_raw_export(S.messages_from_orders(spark, sf_dir), path, EXPORT_MS)
    rows = spark.read.schema("window string, id string, user_id string, address string, date date, body string").json(path)
    return rows.groupBy("window").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.min("date").alias("oldest"), F.max("date").alias("newest"),
        F.count("body").alias("bodies"),
    )


def large_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages written as export documents of about 5,000 and read back in splits, with those that came back unchanged."""
    path = scratch_dir(spark)
    messages = S.messages_from_orders(spark, sf_dir)
    documents = -(-S.load(spark, sf_dir, "orders").count() // 5000) or 1
    write_exports(messages.withColumn("window", F.expr(f"concat('part ', CAST(id AS bigint) % {documents})")), path)
    read = read_large_export(spark, path)
    sent = messages.select(F.col("id").alias("_id"), F.xxhash64("address", "body", "date").alias("_sent"))
    joined = read.join(sent, read["id"] == sent["_id"], "left")
    return joined.groupBy("window").agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count_if(F.xxhash64("address", "body", "date") == F.col("_sent")).alias("unchanged")
    )


def parser_report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a whole inbox in files, and what they hold."""
    path = scratch_dir(spark)
    staged = cut_lineage(parse_stages(S.messages_from_orders(spark, sf_dir)))
    rows, updates = transactions_of(staged), balance_updates_of(staged)
    write_parser_report(rows, updates, reports.parse_summary(staged), path)
    rows = spark.read.schema(rows.schema).json(f"{path}/transactions")
    updates = spark.read.schema(updates.schema).json(f"{path}/balance_updates")
    summary = spark.read.schema("total bigint").json(f"{path}/summary")

    def part(name: str, frame: DataFrame, group: str, value: str) -> DataFrame:
        return frame.groupBy(F.expr(group).alias("kind")).agg(
            F.count("*").alias("n"), F.expr(f"CAST(sum({value}) AS double)").alias("total")
        ).select(F.lit(name).alias("file"), "*")

    return (
        part("transactions", rows, "status", "amount")
        .unionByName(part("balance_updates", updates, "'balance'", "balance"))
        .unionByName(part("summary", summary, "'total'", "total"))
    )


def stage_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three stage outputs of a whole inbox in files, counted by their verdicts."""
    path = scratch_dir(spark)
    staged = parse_stages(S.messages_from_orders(spark, sf_dir))
    schemas = {name: frame.schema for name, frame in stage_outputs(staged).items()}
    write_stage_outputs(staged, path)
    read = {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}
    verdicts = {"parser": "coalesce(layer1.reason, 'passed')", "regex": "coalesce(layer2.rule, layer2.reason)", "haiku": "reason"}
    counted = [
        read[name].groupBy(F.expr(verdict).alias("verdict")).agg(F.count("*").alias("n")).select(F.lit(name).alias("file"), "*")
        for name, verdict in verdicts.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def category_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed categories against the display labels: what shows as uncategorized."""
    staged = parse_stages(S.messages_from_orders(spark, sf_dir)).filter("category IS NOT NULL")
    labels = review.category_labels(spark).withColumnRenamed("category", "label_key")
    joined = staged.join(F.broadcast(labels), F.col("category") == F.col("label_key"), "left")
    return joined.groupBy("category").agg(
        F.count("*").alias("n"), F.count_if(F.col("category_label").isNull()).alias("shown_uncategorized")
    )


def editor_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger categories that the editor knows for the row's type."""
    options = edits.editor_options(spark).select("type", "category", F.lit(True).alias("known"))
    rows = S.ledger_from_events(spark, sf_dir).withColumn("category", F.initcap("category"))
    joined = rows.join(F.broadcast(options), ["type", "category"], "left")
    return joined.groupBy("type", "category").agg(F.count("*").alias("n"), F.count("known").alias("known"))


def window_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = S.messages_from_orders(spark, sf_dir)
    return messages.groupBy(F.coalesce(window_label(F.col("date"), NOW_MS), F.lit("older")).alias("window")).agg(F.count("*").alias("n"))


def escalation_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = escalation.candidate_report(parse_stages(S.messages_from_orders(spark, sf_dir)))
    return queue.select("id", "original_parse_failure", F.col("original_amount").cast("double").alias("original_amount"))


def _stream_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inbox as a stream; the single input file is spread before the per-row work."""
    schema = S.load(spark, sf_dir, "orders").schema
    orders = spark.readStream.schema(schema).parquet(f"{sf_dir}/orders*.parquet")
    return S.inbox(orders.repartition(spark.sparkContext.defaultParallelism, "o_orderkey"))


def _finish(stream: DataFrame, spark: SparkSession) -> DataFrame:
    base = scratch_dir(spark)
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True)
        .start(f"{base}/out")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def stream_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _finish(streams.parse_stream(_stream_inbox(spark, sf_dir)), spark)
    return rows.groupBy("stage").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount"))


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message arrives twice; one copy per reference or text and user remains."""
    parsed = streams.parse_stream(_stream_inbox(spark, sf_dir))
    twice = parsed.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    rows = _finish(streams.dedup_stream(twice, "20000 days").drop("copy"), spark)
    return rows.groupBy("matched_rule").agg(F.count("*").alias("n"))


def stream_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_dir(spark)
    streams.balance_stream(_stream_inbox(spark, sf_dir), f"{base}/balances", f"{base}/ckpt").awaitTermination()
    stored = streams.balances(spark, f"{base}/balances")
    return stored.select("user_id", "account_number_masked", F.col("balance").cast("double").alias("balance"), "message_date")


def stream_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_dir(spark)
    streams.funnel_table(streams.parse_stream(_stream_inbox(spark, sf_dir)), f"{base}/funnel", f"{base}/ckpt").awaitTermination()
    return streams.funnel_windows(spark, f"{base}/funnel")


def stream_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = S.load(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    rows = events.selectExpr(
        "CAST(event_id AS string) AS id", "CAST(user_id AS string) AS user_id", "concat('A', event_id % 3) AS account_id",
        "to_date(ts) AS txn_date",
        "CAST(CASE WHEN event_type IN ('purchase', 'error') THEN -floor(value) ELSE floor(value) END AS decimal(38,2)) AS amount",
    )
    return _finish(streams.transfer_stream(rows), spark).withColumn("magnitude", F.col("magnitude").cast("double"))


def stream_transfer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the days that are closed when the events end, with their counterpart or none."""
    rows = S.ledger_from(spark.readStream.schema(S.load(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet"))
    with state_on_disk(spark):
        return _finish(streams.transfer_rows_stream(rows), spark)


def stream_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags, links and pairs of the runs of days that are closed when the events end."""
    base = scratch_dir(spark)
    rows = S.ledger_from(spark.readStream.schema(S.load(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet"))
    pairing_table(rows, F.col("status") != "user_reviewed", f"{base}/paired", f"{base}/ckpt").awaitTermination()
    return spark.read.schema(PAIRED).parquet(f"{base}/paired").select(
        "id", "run", "status", "is_contra", "possible_contra_of", "txn_group_id", "possible_duplicate_of", "duplicate_ref"
    )


def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymill.sources.messages import read_buckets

    base = scratch_dir(spark)
    streams.ledger_stream(_stream_inbox(spark, sf_dir), base, f"{base}/ckpt").awaitTermination()
    stored = read_buckets(spark, f"{base}/ledger", LEDGER)
    return stored.groupBy("is_contra").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount"))


def all_queries() -> dict[str, Query]:
    named = {
        f.__name__: f
        for f in (
            monthly_debits, filter_drop_reasons, rule_hits, body_filter_documents, body_filter_conversations,
            extract_date_formats, vpa_class, review_routing, dedup_reference_or_body, dedup_priority, dedup_by_reason,
            duplicate_flags, duplicate_decisions, transfer_candidates, transfer_tiers, transfer_pairs_exact,
            infra_group_spread, transfer_decisions, transfer_notes, account_dim, balance_latest, ingest_summary,
            ingest_rows, page_submit_paired, feed_page, feed_history, needs_review, display_rows, ledger_violations, edit_overlay, split_apply,
            page_submit, llm_answers, model_outcomes, fallback_fields, extract_merchant, infrastructure_senders, row_by_id,
            feed_page_index, feed_page_seek, maintained_counts, stream_counts, report_samples, export_windows, large_exports, parser_report_files, stage_files, category_crosswalk, editor_options, window_labels, escalation_queue,
            stream_parse, stream_dedup, stream_balance, stream_funnel, stream_transfers, stream_transfer_rows, stream_pairing, stream_ledger,
        )
    }
    debit, credit = fallback.direction_votes("_low")
    named["extract_amount"] = _on_documents("extract_amount", {"amount": f"CAST({X.amount('_text', '_low')} AS double)"})
    named["extract_account"] = _on_documents("extract_account", {"account": X.account("_text", "_low")})
    named["extract_reference"] = _on_documents("extract_reference", {"reference": X.payment_reference("_text", "_low")})
    named["extract_balance"] = _on_documents("extract_balance", {"balance": f"CAST({X.balance('_text', '_low')} AS double)"})
    named["bank_detect"] = _on_documents("bank_detect", {"bank": X.bank("_low")})
    named["channel_detect"] = _on_documents("channel_detect", {"channel": X.channel("_text", "_low")})
    named["self_transfer_detect"] = _on_documents("self_transfer_detect", {"self_transfer": X.is_self_transfer("_low")})
    named["direction_vote"] = _on_documents(
        "direction_vote", {"debit_votes": debit, "credit_votes": credit, "direction": fallback.direction_from_votes(debit, credit)}
    )
    named["taxonomy_best"] = _on_documents("taxonomy_best", {"entry": best_entry("_low", "true", "100")})
    named["sender_inventory"] = lambda spark, sf_dir: sender_inventory(S.messages_from_orders(spark, sf_dir))
    named["sender_totals"] = lambda spark, sf_dir: sender_totals(S.messages_from_orders(spark, sf_dir))
    named["funnel"] = _staged(reports.funnel)
    named["failure_breakdown"] = _staged(reports.failure_breakdown)
    named["category_breakdown"] = _staged(reports.category_breakdown)
    named["all_reports"] = _staged(reports.all_reports)
    named["parse_summary"] = _staged(reports.parse_summary)
    named["fp_fn"] = _staged(reports.filter_quality)
    for number, rule in enumerate(rules.RULES, start=1):
        named[f"parse_{rule.id.lower()}"] = _parsed(S.TEMPLATES[number])
    for number, name in ((27, "escalated"), (28, "classified"), (29, "no_direction"), (30, "no_amount")):
        named[f"fallback_{name}"] = _parsed(S.TEMPLATES[number])
    for name, template in S.QUIRKS.items():
        named[f"quirk_{name}"] = _parsed(template)
    return named
