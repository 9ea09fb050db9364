"""Keyed-state pairing over several batches: late rows, restarts, bounded state."""

import datetime as dt
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from tallymill.operators.transfers import replay_ledger, transfer_candidates
from tallymill.plans.samples import ledger_from_events
from tallymill.streaming import pairing
from tallymill.streaming.pairing import PAIRED, pairing_table
from tallymill.streaming.streams import transfer_rows_stream

SAME = ["id", "status", "is_contra", "possible_contra_of", "txn_group_id", "possible_duplicate_of"]


def test_closed_runs_equal_the_batch_result(spark, sf_dir, tmp_path):
    """Three files in order of days, the last with a row too late; the rows of closed runs come out once, as in one batch."""
    ledger = ledger_from_events(spark, sf_dir)
    path, table, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    cuts = [dt.date(2024, 1, 1), dt.date(2024, 1, 12), dt.date(2024, 1, 20), dt.date(2024, 3, 1)]
    late = ledger.filter("txn_date = DATE '2024-01-02'").limit(1).withColumn("id", F.lit("late"))
    is_new = F.col("status") != "user_reviewed"
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = ledger.filter((F.col("txn_date") >= a) & (F.col("txn_date") < b))
        (part if i < 2 else part.unionByName(late)).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(ledger.schema).option("maxFilesPerTrigger", 1).parquet(path)
        query = pairing_table(stream, is_new, table, state)
        query.awaitTermination()
    assert query.exception() is None
    got = spark.read.schema(PAIRED).parquet(table)
    assert got.count() == got.select("id").distinct().count() > 0 and got.filter("id = 'late'").count() == 0
    whole = replay_ledger(ledger, is_new).join(got.select("id"), "id", "left_semi")
    assert got.select(SAME).exceptAll(whole.select(SAME)).count() == 0 == whole.select(SAME).exceptAll(got.select(SAME)).count()
    # what is not out yet is of the last days
    waiting = ledger.filter("amount <> 0").join(got.select("id"), "id", "left_anti")
    last = ledger.agg(F.max("txn_date")).first()[0]
    runs = got.agg(F.max("run")).first()[0]
    assert 0 < waiting.count() < ledger.count() / 2 and runs <= last - dt.timedelta(days=4)
    # nothing new: nothing comes out again
    before = got.count()
    pairing_table(spark.readStream.schema(ledger.schema).parquet(path), is_new, table, state).awaitTermination()
    assert spark.read.schema(PAIRED).parquet(table).count() == before


def test_rows_find_their_counterpart_over_batches(spark, sf_dir, tmp_path):
    """Days in two files: the rows of closed days come out once, with the counterpart of the batch job or none, and the state
    holds no more than the rows of the last days."""
    ledger = ledger_from_events(spark, sf_dir).filter("user_id < '3'")
    path, table, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for start, stop in (("2024-01-01", "2024-01-15"), ("2024-01-15", "2024-03-01")):
        ledger.filter(F.col("txn_date").between(F.lit(start).cast("date"), F.date_sub(F.lit(stop).cast("date"), 1))).coalesce(1).write.mode("append").parquet(path)
        rows = transfer_rows_stream(spark.readStream.schema(ledger.schema).parquet(path))
        query = rows.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(table)
        query.awaitTermination()
    got = spark.read.schema(rows.schema).parquet(table)
    assert got.count() == got.select("id").distinct().count() > 0
    batch = transfer_candidates(ledger)
    closed = batch.join(got.select("id"), "id", "left_semi")
    found = got.filter("partner_id IS NOT NULL").select(batch.columns)
    assert found.exceptAll(batch).count() == 0 == closed.select(batch.columns).exceptAll(found).count()
    held = sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"] if s["operatorName"] == "symmetricHashJoin")
    last = ledger.agg(F.max("txn_date")).first()[0]
    assert held <= 12 * ledger.filter(F.col("txn_date") >= last - dt.timedelta(days=6)).count()


def test_a_users_runs_close_together():
    """One timer for a key: rows of several magnitudes and days wait in one list, those that the watermark closes leave at once."""
    class Held(list):
        calls = 0

        def get(self):
            Held.calls += 1
            return iter(list(self))

        appendList = list.extend

        def put(self, rows):
            self[:] = rows

    class Handle:
        def __init__(self):
            self.held, self.timers = Held(), set()
            self.getListState = lambda *_: self.held
            self.registerTimer = self.timers.add

    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    row = lambda i, m, n, a: (m, i, a, day(n), 1 if a == "A" else -1, None, "approved", True, False, False, False, None, None, pd.Timestamp(day(n)))
    rows = [row("1", 5, 0, "A"), row("2", 5, 1, "B"), row("3", 7, 3, "A"), row("4", 9, 9, "A")]
    keyed, handle = pairing.ClosedRuns(), Handle()
    keyed.init(handle)
    list(keyed.handleInputRows(("u", 0), iter([pd.DataFrame(rows, columns=pairing.COLUMNS)]), None))
    assert len(handle.timers) == 1
    now = (day(6) - dt.date(1970, 1, 1)).days * pairing.DAY_MS
    out = pd.concat(keyed.handleExpiredTimer(("u", 0), SimpleNamespace(getCurrentWatermarkInMs=lambda: now), None))
    assert sorted(out["id"]) == ["1", "2", "3"] and [r[1] for r in handle.held] == ["4"] and Held.calls == 1
    assert out.set_index("id")["possible_contra_of"].to_dict() == {"1": "2", "2": "1", "3": None}
    assert len(handle.timers) == 2
