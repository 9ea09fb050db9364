"""Export files of any size: one JSON document with an array of messages, read in many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymill.operators.skew import cut_lineage
from tallymill.schemas import RAW_EXPORT
from tallymill.sources.messages import export_date_ms

PLACE = ["_file", "_block", "_at"]


def _opens(text: Column, inside: bool) -> Column:
    """Opening braces outside strings. Escapes are gone from the text; ``inside``: it begins within a string."""
    rest = F.regexp_replace(text, r'^[^"]*+(?:"|\z)', "") if inside else text
    bare = F.regexp_replace(rest, r'"[^"]*+(?:"|\z)', "")
    return F.length(bare) - F.length(F.translate(bare, "{", ""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text between closing braces, with its place in the file, its number of quotes, and its opening braces for either state at its
    begin. A brace is never escaped, so no escape lies across a border."""
    read = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.col("value").alias("_text"),
        F.monotonically_increasing_id().alias("_at"),
    )
    plain = read.withColumn("_plain", F.regexp_replace("_text", r"(?s)\\.", ""))
    quotes = F.length("_plain") - F.length(F.translate("_plain", '"', ""))
    counted = plain.select(*PLACE, "_text", quotes.alias("_quotes"), _opens(F.col("_plain"), False).alias("_out"), _opens(F.col("_plain"), True).alias("_in"))
    return cut_lineage(counted)


def _running(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Sums of a column over a file, up to and with each row: blocks are summed first, so that no file is one task's work."""
    blocks = rows.groupBy("_file", "_block").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("_file").orderBy("_block")) - F.col("_sum")
    starts = blocks.select("_file", "_block", before.alias("_start"))
    within = F.sum(value).over(Window.partitionBy("_file", "_block").orderBy("_at"))
    return rows.withColumn("_within", within).join(starts, ["_file", "_block"]).withColumn(name, F.col("_start") + F.col("_within")).drop("_start", "_within")


def read_large_export(spark: SparkSession, path: str, user_id: str | None = None) -> DataFrame:
    """Messages of raw-export JSON files with the window label, as the multi-line reader gives them, but a file is read in as many
    tasks as it has splits.

    Files are cut at closing braces. Running counts of quotes tell which braces lie in a string, running counts of braces where a message
    ends; both are sums over blocks and within them, on numbers alone. Texts move once, to their message. A file holds one
    document whose own fields are plain values; message fields may be nested or missing, an empty list of messages gives no rows, and so does
    a file without one.
    """
    pieces = _pieces(spark, path)
    numbers = _running(pieces.drop("_text"), "_quotes", "_q")
    inside = (F.col("_q") - F.col("_quotes")) % 2 == 1
    open_end = F.col("_q") % 2 == 1
    steps = numbers.select(
        *PLACE, open_end.alias("_open"), (F.when(inside, F.col("_in")).otherwise(F.col("_out")) - F.when(open_end, 0).otherwise(1)).alias("_step")
    )
    ends = _running(steps, "_step", "_depth").select(*PLACE, F.when(~F.col("_open") & (F.col("_depth") <= 1), 1).otherwise(0).alias("_ends"))
    numbered = _running(ends, "_ends", "_n").select(*PLACE, (F.col("_n") - F.col("_ends")).alias("_message"))
    parts = F.array_sort(F.collect_list(F.struct("_block", "_at", "_text")))
    whole = (
        pieces.select(*PLACE, "_text").join(numbered, PLACE).groupBy("_file", "_message").agg(parts.alias("_parts"))
        .select("_file", "_message", F.concat(F.array_join(F.transform("_parts", lambda p: p["_text"]), "}"), F.lit("}")).alias("_json"))
    )
    head = r'(?s)^\s*(\{.*?"messages"\s*:\s*\[)\s*(\{.*)$'
    first = F.col("_message") == 0
    body = F.when(first, F.regexp_extract("_json", head, 2)).otherwise(F.regexp_replace("_json", r"^[\s,]+", ""))
    schema = RAW_EXPORT["messages"].dataType.elementType
    rows = whole.withColumn("_body", body).filter(F.startswith("_body", F.lit("{"))).select("_file", F.from_json("_body", schema).alias("m"))
    label = F.from_json(F.concat(F.regexp_extract("_json", head, 1), F.lit("]}")), RAW_EXPORT)["window"]
    heads = whole.filter(first).select("_file", label.alias("window"))
    return rows.join(heads, "_file").select(
        "m.id",
        F.lit(user_id).cast("string").alias("user_id"),
        "m.address",
        "m.body",
        export_date_ms(F.col("m.date")).alias("date"),
        "window",
    )


def write_exports(messages: DataFrame, path: str) -> None:
    """Messages as export files, one document for each value of ``window``: a line for its head, one for each message.

    A document is written by one task, as it is one file; deal messages to many windows. ``id`` and ``window`` are not null."""
    place = Window.partitionBy("window").orderBy("id", "date")
    last = F.lead("id").over(place).isNull()
    message = F.to_json(F.struct("id", "address", F.col("date").cast("string").alias("date"), "body"), {"ignoreNullFields": "false"})
    lines = messages.withColumn("_last", last).select(
        "window", F.col("id").alias("_id"), F.col("date").alias("_date"), F.concat(message, F.when(F.col("_last"), "").otherwise(",")).alias("value")
    )
    each_window = messages.select("window").distinct()
    head = F.concat(F.regexp_replace(F.to_json(F.struct("window")), r"\}\z", ""), F.lit(',"messages":['))
    ends = each_window.select("window", F.posexplode(F.array(head, F.lit("]}"))).alias("_end", "value"))
    ordered = lines.withColumn("_kind", F.lit(1)).unionByName(
        ends.select("window", "value", (F.col("_end") * 2).alias("_kind")), allowMissingColumns=True
    )
    folder = F.sha2("window", 256).alias("part")
    ordered.select(folder, "*").repartition("part").sortWithinPartitions("part", "_kind", "_id", "_date").select("part", "value").write.mode(
        "overwrite"
    ).partitionBy("part").text(path)
