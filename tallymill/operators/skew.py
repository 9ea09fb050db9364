"""Skew-safe lookups: give every row the values of its group, however large one group is."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Groups beyond this many rows are spread over several join keys. The list of such groups has at most
# (all rows / HOT_ROWS) entries, so it is broadcast and rows move once in a lookup.
HOT_ROWS = 2_000_000
# Rows of one task of CPU-heavy work: under a minute at half a millisecond a row.
ROWS_PER_TASK = 100_000


def attach(
    rows: DataFrame, groups: DataFrame, keys: list[str], row_id: str, size: str = "_n", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Left join of rows to one row per group, where ``groups[size]`` counts the rows of the group.

    Rows of a hot group get a salt from their id and its group row is repeated once per salt, so no join
    key carries more than about ``hot_rows`` rows. Cold groups are joined as they are.
    """
    salts = F.ceil(F.col(size) / hot_rows).cast("int")
    hot = groups.filter(F.col(size) > hot_rows).select(*keys, salts.alias("_salts"))
    salted_rows = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(row_id), F.col("_salts")).cast("int"), F.lit(0))
    )
    spread = F.when(F.col(size) > hot_rows, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))
    salted_groups = groups.withColumn("_salt", F.explode(spread))
    return salted_rows.join(salted_groups, [*keys, "_salt"], "left").drop("_salt", "_salts")


def hot_groups(rows: DataFrame, keys: list[str], within: list[str], hot_rows: int = HOT_ROWS) -> list[int]:
    """Hashes of the groups beyond ``hot_rows`` rows, at most (all rows / hot_rows) of them. ``within`` are columns among the keys
    that are counted first: a group is looked for only inside a larger one that is that large itself."""
    found = None
    for columns in filter(None, (within, keys)):
        among = rows if found is None else rows.filter(F.xxhash64(*within).isin(found))
        counted = among.groupBy(F.xxhash64(*columns).alias("_group")).agg(F.count("*").alias("_n"))
        found = [r["_group"] for r in counted.filter(F.col("_n") > hot_rows).select("_group").collect()]
        if not found:
            return []
    return found


def over_groups(
    rows: DataFrame, keys: list[str], row_id: str, values: dict[str, Column], hot: list[int]
) -> DataFrame:
    """Rows with aggregates of their group, nulls being equal. Every row moves once and is not joined; those of the ``hot``
    groups are spread by their id and get what a partial aggregate found, which is one row for each such group."""
    if not hot:
        # dealt before the arguments of the aggregates are made, so that those do not travel
        dealt = rows.repartition(*keys)
        return dealt.withColumns({name: value.over(Window.partitionBy(*keys)) for name, value in values.items()})
    is_hot = F.xxhash64(*keys).isin(hot)
    salted = rows.withColumn("_salt", F.when(is_hot, F.xxhash64(row_id))).repartition(*keys, "_salt")
    window = Window.partitionBy(*keys, "_salt")
    totals = rows.filter(is_hot).groupBy(*[F.col(k).alias(f"_of_{i}") for i, k in enumerate(keys)]).agg(
        F.lit(True).alias("_hot"), *[value.alias(f"_hot_{name}") for name, value in values.items()]
    )
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{i}")) for i, k in enumerate(keys)])
    found = salted.withColumns({name: value.over(window) for name, value in values.items()}).join(F.broadcast(totals), same, "left")
    return found.withColumns(
        {name: F.when(F.col("_hot"), F.col(f"_hot_{name}")).otherwise(F.col(name)) for name in values}
    ).select(*rows.columns, *values)


def at_least_one_partition_per_core(frame: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Spread a table over all cores before CPU-heavy per-row work, and over more tasks if one would get more than about
    ``rows_per_task`` rows, since a few megabytes of a table can be an hour's work; others are left alone."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, -(-frame.count() // rows_per_task))
    enough = len(frame.inputFiles()) >= cores and frame.rdd.getNumPartitions() >= tasks
    return frame if enough else frame.repartition(tasks, key)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a folder of this machine under a local master;
    on a cluster it is an error, since executors would not see each other's files."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


def cut_lineage(frame: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, and readers take the columns they need."""
    path = scratch_dir(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
