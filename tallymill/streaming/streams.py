"""Stream forms of the jobs. Stateless work uses the very same columns as the batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallymill.operators.accounts import KEYS
from tallymill.operators.counts import CELL
from tallymill.operators.dedup import ACTIVE, repeat_key
from tallymill.operators.ledger import affected_rows, update_ledger
from tallymill.operators.parse import balance_updates_of, parse_stages, transactions_of
from tallymill.operators.reports import _staged_counts
from tallymill.schemas import ACCOUNTS, LEDGER, MESSAGES, struct_of
from tallymill.sources.messages import read_buckets, user_bucket, write_buckets
from tallymill.streaming.counterparts import FOUND, PACKED, PARTS, ClosedDays
from tallymill.streaming.pairing import PROVIDER, ROCKS

POLL = "30 minutes"
BALANCES = struct_of(
    "user_id string, account_number_masked string, balance decimal(38,2), message_date date, "
    "message_time timestamp, raw_sms_id string"
)


def message_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(MESSAGES)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def parse_stream(messages: DataFrame) -> DataFrame:
    """Continuous filter and parse; stateless."""
    return parse_stages(messages).withColumn("message_time", F.timestamp_millis("date"))


def dedup_stream(parsed: DataFrame, horizon: str = "2 days") -> DataFrame:
    """Drop repeats of a reference or text per user within the horizon."""
    keyed = parsed.filter("outcome = 'matched'").withColumn("repeat_key", repeat_key())
    return keyed.withWatermark("message_time", horizon).dropDuplicatesWithinWatermark(["user_id", "repeat_key"])


def transfer_stream(rows: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Where transfers may be: days and accounts of one user with opposite legs at most one day apart.

    ``rows`` carry ``user_id, account_id, txn_date, amount``. Both sides are first reduced to one row per
    user, magnitude, day and account, so a busy account joins once and not once per row; choosing the
    rows is the ledger's work. State is bounded by the watermark.
    """
    legs = rows.filter("amount IS NOT NULL AND amount <> 0").withColumn("day_time", F.col("txn_date").cast("timestamp"))

    def side(sign: str, prefix: str) -> DataFrame:
        picked = legs.filter(f"amount {sign} 0").select(
            F.col("user_id").alias(f"{prefix}_user_id"),
            F.abs("amount").alias(f"{prefix}_magnitude"),
            F.col("account_id").alias(f"{prefix}_account_id"),
            F.col("day_time").alias(f"{prefix}_day_time"),
        )
        return picked.withWatermark(f"{prefix}_day_time", lateness).dropDuplicatesWithinWatermark(picked.columns)

    pairs = side("<", "debit").join(
        side(">", "credit"),
        F.expr(
            "debit_user_id = credit_user_id AND debit_magnitude = credit_magnitude "
            "AND debit_account_id <> credit_account_id "
            "AND credit_day_time >= debit_day_time - INTERVAL 1 DAY "
            "AND credit_day_time <= debit_day_time + INTERVAL 1 DAY"
        ),
    )
    return pairs.select(
        F.col("debit_user_id").alias("user_id"),
        F.col("debit_magnitude").alias("magnitude"),
        F.col("debit_account_id").alias("debit_account"),
        F.to_date("debit_day_time").alias("debit_day"),
        F.col("credit_account_id").alias("credit_account"),
        F.to_date("credit_day_time").alias("credit_day"),
    )


def transfer_rows_stream(rows: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Each active row with its chosen counterpart, or with none, once no counterpart can come any more: ``id, user_id,
    candidates, tier, partner_id`` as in ``transfer_candidates``.

    Rows move once, to one of ``PARTS`` keys of their user and magnitude, and wait there packed by day; what leaves is found from the
    first rows of three days (see ``counterparts``). State is one packed copy of the rows of open days, on disk: it needs
    the RocksDB provider, to which this sets the session, since the caller starts the query (``state_on_disk`` sets it back).
    """
    rows.sparkSession.conf.set(PROVIDER, ROCKS)
    magnitude = F.abs("amount")
    packed = {
        "magnitude": magnitude, "sign": F.when(F.col("amount") > 0, 1).otherwise(-1),
        "created_us": F.unix_micros(F.col("created_at").cast("timestamp")),
    }
    legs = (
        rows.filter("txn_date IS NOT NULL AND amount IS NOT NULL AND amount <> 0 AND NOT is_deleted AND NOT is_infrastructure AND NOT is_contra")
        .filter(F.col("status").isin(*ACTIVE, "user_reviewed"))
        .withColumn("day_time", F.col("txn_date").cast("timestamp"))
        .withWatermark("day_time", lateness)
        .select(
            F.window("day_time", "1 day"), F.unix_date("txn_date").alias("day"),
            F.pmod(F.xxhash64("user_id", magnitude), F.lit(PARTS)).cast("int").alias("part"),
            F.to_json(F.array(*[packed.get(c, F.col(c)).cast("string") for c in PACKED])).alias("packed"),
        )
    )
    # a row is late when its whole day is behind the watermark
    keyed = legs.select(F.window_time("window").alias("day_end"), "day", "part", "packed")
    return keyed.groupBy("part").transformWithStateInPandas(
        statefulProcessor=ClosedDays(), outputStructType=FOUND, outputMode="Append", timeMode="EventTime"
    )


def funnel_stream(parsed: DataFrame, length: str = "90 days", lateness: str = "2 days") -> DataFrame:
    """Funnel counts per tumbling window of message time."""
    return (
        parsed.withWatermark("message_time", lateness)
        .groupBy(F.window("message_time", length))
        .agg(*_staged_counts())
        .select(F.to_date("window.start").alias("window_start"), F.to_date("window.end").alias("window_end"), "*")
        .drop("window")
    )


def funnel_table(parsed: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """The funnel as a table that is right after every micro-batch, open windows included: each batch writes the windows it
    changed, and a batch that runs again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return _start(funnel_stream(parsed).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint), once)


def funnel_windows(spark: SparkSession, table: str) -> DataFrame:
    """The latest counts of each window."""
    rows = spark.read.parquet(table)
    window = ["window_start", "window_end"]
    counts = [c for c in rows.columns if c not in (*window, "batch")]
    return rows.groupBy(*window).agg(F.max_by(F.struct(*counts), "batch").alias("_last")).select(*window, "_last.*")


def _buckets_of(rows: DataFrame) -> list[int]:
    """Buckets of the users in a micro-batch; at most ``BUCKETS`` numbers."""
    return [r[0] for r in rows.select(user_bucket(F.col("user_id"))).distinct().collect()]


def _start(writer, once: bool) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)).start()


def balance_stream(messages: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Latest balance per account, late messages included. The state store holds one row for each account; each
    batch writes the accounts it changed, and a batch that runs again replaces its own."""
    columns = ["balance", "message_date", "message_time", "raw_sms_id"]
    newest = F.max_by(F.struct(*columns), F.struct("message_date", "message_time", "raw_sms_id")).alias("_b")
    updates = balance_updates_of(parse_stages(messages)).filter("account_number_masked IS NOT NULL AND balance IS NOT NULL")
    latest = updates.groupBy(*KEYS).agg(newest).select(*KEYS, "_b.*")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return _start(latest.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint), once)


def balances(spark: SparkSession, table: str) -> DataFrame:
    """The latest balance of each account that a stream wrote."""
    rows = spark.read.parquet(table)
    columns = [f.name for f in BALANCES.fields if f.name not in KEYS]
    return rows.groupBy(*KEYS).agg(F.max_by(F.struct(*columns), "batch").alias("_last")).select(*KEYS, "_last.*")


def count_stream(changes: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Counts of ledger cells from a stream of signed changes (the cell's columns and n; a retraction has a negative n).

    The state store holds one number for each cell; each batch writes the cells it changed, and a batch that runs again replaces its own."""
    sums = changes.groupBy(*CELL).agg(F.sum("n").alias("n"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return _start(sums.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint), once)


def counts(spark: SparkSession, table: str) -> DataFrame:
    """The counts that a stream wrote; cells that are left without rows are not there."""
    rows = spark.read.parquet(table)
    return rows.groupBy(*CELL).agg(F.max_by("n", "batch").alias("n")).filter("n <> 0")


def ledger_stream(messages: DataFrame, store: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Exact ledger update per micro-batch.

    Only the buckets of the users in the batch are read and rewritten, and only stored rows that share a
    user and magnitude with the batch are replayed. Messages already stored are skipped.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        staged_path = f"{store}/staged/batch={number}"
        batch.write.mode("overwrite").parquet(staged_path)
        staged = spark.read.parquet(staged_path)
        transactions, balances = transactions_of(staged), balance_updates_of(staged)
        wanted = _buckets_of(staged)
        ledger = read_buckets(spark, f"{store}/ledger", LEDGER, number, wanted)
        accounts = read_buckets(spark, f"{store}/accounts", ACCOUNTS, number, wanted)
        touched = affected_rows(ledger, transactions)
        updated, dimension, _ = update_ledger(transactions, balances, touched, accounts, known_ids=ledger.select("id"))
        untouched = ledger.join(touched.select("id"), "id", "left_anti")
        write_buckets(updated.unionByName(untouched), f"{store}/ledger", number)
        write_buckets(dimension, f"{store}/accounts", number)

    staged = parse_stages(messages)
    return _start(staged.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint), once)
