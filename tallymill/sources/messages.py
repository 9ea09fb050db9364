"""Message tables in and out: windowed scans, export readers, stage writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymill.schemas import MESSAGES, PARSER_REPORT, RAW_EXPORT

DAY_MS = 24 * 60 * 60 * 1000
WINDOW_DAYS = 90
WINDOW_COUNT = 4


def window_filter(date: Column, now_ms: int, from_days: int, to_days: int) -> Column:
    """``now - to_days < date <= now - from_days``; plain comparisons, so they reach the file scan."""
    return (date > now_ms - to_days * DAY_MS) & (date <= now_ms - from_days * DAY_MS)


def scan_messages(
    spark: SparkSession, path: str, now_ms: int, from_days: int, to_days: int, newest_first: bool = False
) -> DataFrame:
    """All messages of a window from a Parquet table. The total order costs a range shuffle, so it is
    only made on request; jobs that need arrival order sort by ``date`` and ``id`` themselves."""
    rows = spark.read.schema(MESSAGES).parquet(path).filter(window_filter(F.col("date"), now_ms, from_days, to_days))
    return rows.orderBy(F.desc("date"), "id") if newest_first else rows


def window_label(date: Column, now_ms: int) -> Column:
    """Label of the 90-day window a message falls in; null outside the four windows."""
    label = F.lit(None).cast("string")
    for i in reversed(range(WINDOW_COUNT)):
        lo, hi = i * WINDOW_DAYS, (i + 1) * WINDOW_DAYS
        label = F.when(window_filter(date, now_ms, lo, hi), f"{lo} → {hi} days").otherwise(label)
    return label


def is_numeric_sender(address: Column) -> Column:
    return address.rlike(r"^[0-9]+\z")


def sender_inventory(messages: DataFrame) -> DataFrame:
    """Distinct named senders with their message counts; numeric senders are left out."""
    return (
        messages.filter(F.col("address").isNotNull() & ~is_numeric_sender(F.col("address")))
        .groupBy("address")
        .agg(F.count("*").alias("n"))
    )


def sender_totals(messages: DataFrame) -> DataFrame:
    """Total messages (all senders) and number of distinct named senders, one row."""
    named = F.when(~is_numeric_sender(F.col("address")), F.col("address"))
    return messages.agg(F.count("*").alias("total_count"), F.countDistinct(named).alias("senders"))


def export_date_ms(date: Column) -> Column:
    """Message time of an export: a day, an ISO time, or epoch milliseconds, all given as text."""
    epoch = date.try_cast("bigint")
    return F.coalesce(epoch, F.unix_millis(date.try_cast("timestamp")))


def read_raw_export(spark: SparkSession, path: str, user_id: str | None = None) -> DataFrame:
    """Messages of raw-export JSON files, with the window label."""
    files = spark.read.schema(RAW_EXPORT).option("multiLine", True).json(path)
    return files.select("window", F.explode("messages").alias("m")).select(
        "m.id",
        F.lit(user_id).cast("string").alias("user_id"),
        "m.address",
        "m.body",
        export_date_ms(F.col("m.date")).alias("date"),
        "window",
    )


def read_parser_report(spark: SparkSession, path: str) -> DataFrame:
    """Rows of parser-report JSON files in message form, with the recorded outcome beside it."""
    files = spark.read.schema(PARSER_REPORT).option("multiLine", True).json(path)
    rows = files.select("window", F.explode("transactions").alias("t"))
    return rows.select(
        F.col("t.raw_sms_id").alias("id"),
        F.col("t.user_id").alias("user_id"),
        F.col("t.address").alias("address"),
        F.col("t.raw_text").alias("body"),
        F.unix_millis(F.col("t.txn_date").cast("timestamp")).alias("date"),
        F.col("t.parse_failure").alias("recorded_failure"),
        F.col("t.amount").alias("recorded_amount"),
        "window",
    )


def slug(window: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(window, r"\s+", "_"), "→", "to")


def write_raw_export(messages: DataFrame, path: str, now_ms: int) -> None:
    """Unfiltered messages as JSON lines, one folder per window."""
    labelled = messages.withColumn("window", slug(window_label(F.col("date"), now_ms)))
    rows = labelled.filter("window IS NOT NULL").select(
        "window", "id", "user_id", "address", F.to_date(F.timestamp_millis("date")).alias("date"), "body"
    )
    rows.write.mode("overwrite").partitionBy("window").json(path)


def write_parser_report(transactions: DataFrame, balance_updates: DataFrame, summary: DataFrame, path: str) -> None:
    transactions.write.mode("overwrite").json(f"{path}/transactions")
    balance_updates.write.mode("overwrite").json(f"{path}/balance_updates")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def stage_outputs(staged: DataFrame) -> dict[str, DataFrame]:
    """Filter verdicts, rule verdicts and escalations of a staged frame."""
    base = ["id", "address", "date", "body"]
    passed = F.col("drop_reason").isNull()
    layer1 = F.struct(
        passed.alias("passed"),
        F.when(F.col("drop_reason") == "sender", "layer0_drop").otherwise(F.col("drop_reason")).alias("reason"),
    )
    matched = F.col("outcome") == "matched"
    result = F.struct(
        "direction", F.abs("amount").alias("amount"), "bank", "channel", "merchant", "account_number_masked",
        "txn_date", "ref_number", "ref_type", "confidence", "possible_contra", "requires_classification",
    )
    reason = F.when(F.col("stage") == "balance_update", "balance_disclosure_no_transaction").otherwise(
        F.col("parse_failure")
    )
    layer2 = F.struct(
        matched.alias("matched"),
        F.col("matched_rule").alias("rule"),
        (F.col("outcome") == "discard").alias("discard"),
        F.when(F.col("outcome") == "discard", reason)
        .when(F.col("outcome") == "none", "no_rule_matched")
        .alias("reason"),
        F.when(matched, result).alias("result"),
    )
    return {
        "parser": staged.select(*base, layer1.alias("layer1")),
        "regex": staged.filter(passed).select(*base, layer2.alias("layer2")),
        "haiku": staged.filter("outcome = 'none'").select(*base, F.lit("no_layer2_rule").alias("reason")),
    }


def write_stage_outputs(staged: DataFrame, path: str) -> None:
    """Parse once into a table, then write the three views of it."""
    spark = staged.sparkSession
    staged.write.mode("overwrite").parquet(f"{path}/staged")
    for name, rows in stage_outputs(spark.read.parquet(f"{path}/staged")).items():
        rows.write.mode("overwrite").json(f"{path}/{name}")


# --- versioned tables, partitioned by user bucket --------------------------------------------------

BUCKETS = 256


def user_bucket(user_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(user_id), F.lit(buckets)).cast("int")


def write_buckets(rows: DataFrame, root: str, version: int, buckets: int = BUCKETS) -> None:
    """Store the buckets that occur in ``rows`` as one version; the other buckets keep their last one.

    The rebalance hint splits a large bucket over several tasks and files.
    """
    placed = rows.withColumn("bucket", user_bucket(F.col("user_id"), buckets)).hint("rebalance", F.col("bucket"))
    placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/v={version}")


def _children(spark: SparkSession, path: str, prefix: str) -> list[int]:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = location.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(location):
        return []
    names = [status.getPath().getName() for status in system.listStatus(location)]
    return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix))


def read_buckets(
    spark: SparkSession, root: str, schema: T.StructType, before: int | None = None, wanted: list[int] | None = None
) -> DataFrame:
    """Newest version of every wanted bucket, older than ``before``; empty where nothing is stored.

    Only folder names are listed, at most one path per bucket is read.
    """
    newest: dict[int, int] = {}
    for version in _children(spark, root, "v="):
        if before is None or version < before:
            for bucket in _children(spark, f"{root}/v={version}", "bucket="):
                newest[bucket] = version
    paths = [f"{root}/v={v}/bucket={b}" for b, v in sorted(newest.items()) if wanted is None or b in wanted]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
