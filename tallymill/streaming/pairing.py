"""Exact pairing as a stream: the rows of a user wait in keyed state until the run of days of their magnitude is closed."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallymill.operators.transfers import RESULT_COLUMNS, replay_group

DAY_MS = 24 * 60 * 60 * 1000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A user's magnitudes are dealt to so many keys: one state call then serves many runs, and no key holds all of a user.
PARTS = 4
#: State of a key: one entry for each row of a run of days that is not closed yet.
WAITING = (
    "magnitude decimal(38,2), id string, account_id string, txn_date date, sign int, ref_number string, status string, is_new boolean, is_infrastructure boolean, "
    "is_contra boolean, is_deleted boolean, possible_contra_of string, txn_group_id string, created_at timestamp"
)
COLUMNS = [part.split()[0] for part in WAITING.replace("38,2", "").split(", ")]
PAIRED = (
    "user_id string, magnitude decimal(38,2), run date, id string, status string, is_contra boolean, possible_contra_of string, "
    "txn_group_id string, pair_reason string, possible_duplicate_of string, duplicate_ref string"
)
OUT = [part.split()[0] for part in PAIRED.replace("38,2", "").split(", ")]


def _day(date) -> int:
    return date.toordinal()


class ClosedRuns(StatefulProcessor):
    """Holds the rows of one user and part of the magnitudes, and replays a run of days of a magnitude when the watermark has passed the
    day after its last one: no row can join it any more, since a row that old is late and left out.

    A key has one timer, for the run that can close first. When it fires, all runs that the watermark closes leave together."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.epoch = pd.Timestamp(0).date().toordinal()

    def _wake(self, day: int) -> None:
        self.handle.registerTimer((day - self.epoch + 2) * DAY_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        days = set()
        for frame in rows:
            # nan and nat differ from themselves
            columns = [[None if x is None or x != x else x for x in frame[c].tolist()] for c in COLUMNS]
            self.waiting.appendList(list(zip(*columns)))
            days |= set(columns[COLUMNS.index("txn_date")])
        self._wake(min(map(_day, days)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed_day = timerValues.getCurrentWatermarkInMs() // DAY_MS + self.epoch - 2
        rows = [dict(zip(COLUMNS, r)) for r in self.waiting.get()]
        last = {}
        for at in sorted({(r["magnitude"], _day(r["txn_date"])) for r in rows}, reverse=True):
            last[at] = last.get((at[0], at[1] + 1), at[1])  # the last day of the run
        for r in rows:
            r["last"] = last[r["magnitude"], _day(r["txn_date"])]
        done = [r for r in rows if r["last"] <= closed_day]
        left = [r for r in rows if r["last"] > closed_day]
        if left:
            self._wake(min(r["last"] for r in left))
        if not done:
            return
        if left:
            self.waiting.put([tuple(r[c] for c in COLUMNS) for r in left])
        else:
            self.waiting.clear()
        out = self.replayed(key[0], done)
        yield pd.DataFrame(out, columns=OUT)

    @staticmethod
    def replayed(user: str | None, rows: list[dict]) -> list[dict]:
        signs: dict[tuple, set] = {}
        for r in rows:
            if not (r["is_deleted"] or r["is_infrastructure"] or r["is_contra"]):
                signs.setdefault((r["magnitude"], r["ref_number"]), set()).add(r["sign"])
        run = lambda r: (r["magnitude"], r["last"])
        out = []
        for _, group in groupby(sorted(rows, key=lambda r: (*run(r), r["is_new"], r["created_at"], r["id"])), key=run):
            held = list(group)
            for r in held:
                r["same_ref"] = r["ref_number"] is not None and len(signs.get((r["magnitude"], r["ref_number"]), ())) > 1
                r.update(dict.fromkeys(RESULT_COLUMNS[-4:]))
            for _ in replay_group(iter(held)):
                pass
            first = min(r["txn_date"] for r in held)
            out += [{**r, "user_id": user, "run": first} for r in held]
        return out

    def close(self) -> None:
        pass


def pairing_stream(rows: DataFrame, is_new: Column, lateness: str = "2 days") -> DataFrame:
    """Rows of closed runs of days with duplicate flags, links and pairs, equal to ``replay_ledger`` over all rows of the run.

    ``rows`` is a stream of ledger rows. A run is closed when the watermark is two days past its last day; rows later than that
    are left out. State holds the rows of open runs only, in the state store (needs the RocksDB provider).
    """
    legs = rows.filter("amount IS NOT NULL AND amount <> 0").withColumns(
        {
            "magnitude": F.abs("amount").cast("decimal(38,2)"),
            "sign": F.when(F.col("amount") > 0, 1).otherwise(-1),
            "is_new": is_new,
            "day_time": F.col("txn_date").cast("timestamp"),
        }
    ).withColumn("part", F.pmod(F.xxhash64("magnitude"), F.lit(PARTS))
    )
    keyed = legs.withWatermark("day_time", lateness).select("user_id", "part", *COLUMNS, "day_time")
    return keyed.groupBy("user_id", "part").transformWithStateInPandas(
        statefulProcessor=ClosedRuns(), outputStructType=PAIRED, outputMode="Append", timeMode="EventTime"
    )


def pairing_table(rows: DataFrame, is_new: Column, table: str, checkpoint: str, once: bool = True, lateness: str = "2 days") -> StreamingQuery:
    """The closed runs as an append-only Parquet table. The query keeps its state in RocksDB; other queries of the session keep
    the provider they had."""
    conf = rows.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKS)
    try:
        writer = pairing_stream(rows, is_new, lateness).writeStream.format("parquet").option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 minutes")).start(table)
    finally:
        conf.set(PROVIDER, before)
