"""Feed pages by key: a stored feed in page order, an index of page heads, and reads that seek instead of counting rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymill.operators.review import PAGE_SIZE, feed_filter, page_count

#: Bytes of a row group of the stored feed: what a page read costs at most, twice where it lies on a border.
ROW_GROUP = 8 << 20
#: Days before this one sort last; newest days come first, and ascending numbers keep the statistics of row groups tight.
FAR_DAY = 4_000_000

ORDER = ["user_id", "_age", "id"]


def store_feed(ledger: DataFrame, path: str, tab: str = "active", status_filter: str = "all", category: str | None = None) -> None:
    """Write the rows of a feed in the order of its pages: by user, newest day first, ties by id; rows without a day come last.

    One range exchange. A user of any size is spread over as many tasks as its rows need, since the range is that of the whole key.
    Each row keeps its place: _part and _at number the range and the row in it."""
    rows = feed_filter(ledger, tab, status_filter, category)
    age = F.coalesce(F.lit(FAR_DAY) - F.unix_date("txn_date"), F.lit(2 * FAR_DAY))
    ordered = rows.withColumn("_age", age).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    placed = ordered.withColumn("_place", F.monotonically_increasing_id())
    placed.select(
        "*", F.shiftright("_place", 33).cast("int").alias("_part"), F.col("_place").bitwiseAND((1 << 33) - 1).alias("_at")
    ).drop("_place").write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(path)


def page_index(feed: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """user_id, page, _age, id: the key of the first row of every page.

    A user's ranges are counted first (one row for each user and range), and running sums of those counts number the rows, so no
    user's rows meet in one task."""
    ranges = feed.groupBy("user_id", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    user = Window.partitionBy("user_id").orderBy("_part")
    starts = ranges.select("user_id", "_part", "_first", (F.sum("_n").over(user) - F.col("_n")).alias("_before"))
    joined = feed.select(*ORDER, "_part", "_at").join(
        starts.withColumnsRenamed({"user_id": "_user", "_part": "_range"}), (F.col("_part") == F.col("_range")) & F.col("user_id").eqNullSafe(F.col("_user"))
    )
    place = F.col("_before") + F.col("_at") - F.col("_first")
    heads = joined.withColumn("_rank", place).filter(F.col("_rank") % page_size == 0)
    return heads.select("user_id", F.expr(f"CAST(_rank DIV {page_size} AS int)").alias("page"), "_age", "id")


def feed_totals(feed: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """user_id, total_count and page_count of each user's feed."""
    return feed.groupBy("user_id").agg(F.count("*").alias("total_count")).withColumn("page_count", page_count(page_size))


def _from(age: int, key: str) -> Column:
    """Rows at or after a key. The day alone comes first: that part reaches the scan and skips row groups."""
    return (F.col("_age") >= age) & ((F.col("_age") > age) | (F.col("id") >= key))


def page_after(feed: DataFrame, user_id: str, age: int, key: str, page_size: int = PAGE_SIZE) -> DataFrame:
    """The rows that follow a row of a feed, which needs no index: what scrolling on reads."""
    rows = feed.filter((F.col("user_id") == user_id) & _from(age, key) & ((F.col("_age") != age) | (F.col("id") != key)))
    return rows.orderBy(*ORDER).limit(page_size)


def page_at(spark: SparkSession, feed_path: str, index_path: str, user_id: str, page: int, page_size: int = PAGE_SIZE) -> DataFrame:
    """Any page of a stored feed, through its index: the heads of the page and of the next one bound the read by keys.

    Two index rows come to the driver. A page past the end, or of a user without rows, is empty."""
    feed = spark.read.parquet(feed_path)
    heads = spark.read.parquet(index_path).filter((F.col("user_id") == user_id) & F.col("page").isin(page, page + 1))
    found = {r["page"]: r for r in heads.limit(2).collect()}
    if page not in found:
        return feed.limit(0)
    rows = feed.filter((F.col("user_id") == user_id) & _from(found[page]["_age"], found[page]["id"]))
    if page + 1 in found:
        rows = rows.filter((F.col("_age") <= found[page + 1]["_age"]) & ~_from(found[page + 1]["_age"], found[page + 1]["id"]))
    return rows.orderBy(*ORDER).limit(page_size)
