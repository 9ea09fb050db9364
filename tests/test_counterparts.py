"""The stream of rows with their counterpart: packed state, late and odd rows, groups of many rows."""

import datetime as dt
import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallymill.operators.transfers import transfer_candidates
from tallymill.streaming import counterparts
from tallymill.streaming.counterparts import FOUND, PROVIDER, ClosedDays, state_on_disk
from tallymill.streaming.streams import transfer_rows_stream

ROW = (
    "id string, user_id string, account_id string, txn_date date, amount decimal(38,2), ref_number string, status string, "
    "is_deleted boolean, is_infrastructure boolean, is_contra boolean, created_at timestamp"
)
START = dt.date(2024, 1, 1)
PAIRS = """WITH legs AS (SELECT *, status IN ('approved', 'pending_review') AS active FROM {rows}
    WHERE NOT is_deleted AND NOT is_infrastructure AND NOT is_contra AND amount <> 0),
  p AS (SELECT a.id, a.user_id, b.id AS partner_id, b.active, b.created_at, CASE WHEN NOT b.active THEN 3 WHEN a.ref_number = b.ref_number THEN 1 ELSE 2 END AS tier
    FROM legs a JOIN legs b ON a.user_id = b.user_id AND a.amount = -b.amount AND a.account_id <> b.account_id
      AND abs(datediff(a.txn_date, b.txn_date)) <= 1 WHERE a.active AND (b.active OR b.status = 'user_reviewed'))
  SELECT id, user_id, count_if(active) AS candidates, min(struct(tier, created_at, partner_id)).tier AS tier,
    min(struct(tier, created_at, partner_id)).partner_id AS partner_id FROM p GROUP BY id, user_id"""


def _run(spark, path, tmp_path, name):
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(path)
    with state_on_disk(spark):
        writer = transfer_rows_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-state"))
        query = writer.trigger(availableNow=True).start(str(tmp_path / name))
        query.awaitTermination()
    return query, spark.read.schema(FOUND).parquet(str(tmp_path / name))


def test_waiting_rows_are_packed(spark, tmp_path):
    """40,000 rows of four days wait in far fewer entries of state, which is on disk; the session's provider is as before."""
    on_heap = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set(PROVIDER, on_heap)
    rows = spark.range(40_000).selectExpr(
        "CAST(id AS string) AS id", "CAST(id % 5000 AS string) AS user_id", "concat('A', id % 2) AS account_id",
        "date_add(DATE '2024-01-01', CAST(id % 4 AS int)) AS txn_date", "CAST(IF(id % 8 < 4, 7, -7) AS decimal(38,2)) AS amount",
        "CAST(id AS string) AS ref_number", "'approved' AS status", "false AS is_deleted", "false AS is_infrastructure",
        "false AS is_contra", "TIMESTAMP '2024-01-01' AS created_at",
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    query, out = _run(spark, str(tmp_path / "in"), tmp_path, "out")
    operators = [o for p in query.recentProgress for o in p["stateOperators"]]
    assert out.count() == 0 and max(o["numRowsTotal"] for o in operators) <= 8 * counterparts.PARTS < rows.count() / 4
    assert all("rocksdbCommitFlushLatency" in o["customMetrics"] for o in operators)
    assert spark.conf.get(PROVIDER) == on_heap


def test_odd_and_late_rows_meet_as_in_a_batch(spark, tmp_path):
    """Nulls, equal times, other states and few values, out of order: what leaves equals all pairs of the rows that were in time."""
    draw = random.Random(4)
    one = lambda *values: draw.choice(values)

    def row(i, day, amount=None, **fixed):
        made = dict(
            id=f"{i:04d}", user_id=one("u", "v", "v", None), account_id=one("A", "B", "C", None), txn_date=START + dt.timedelta(days=day),
            amount=one(None, 0, 5, -5, 5, -5, 6, -6) if amount is None else amount, ref_number=one(None, None, "r", 's"\n', "é"),
            status=one("approved", "pending_review", "user_reviewed", "user_reviewed", "rejected", None), is_deleted=one(*[False] * 9, True),
            is_infrastructure=one(*[False] * 9, True), is_contra=one(*[False] * 9, True),
            created_at=one(None, *[dt.datetime(2024, 1, 1, 0, 0, s) for s in (1, 1, 2, 3)]),
        )
        return {**made, **fixed}

    plain = dict(user_id="w", account_id="A", status="approved", is_deleted=False, is_infrastructure=False, is_contra=False)
    first = [row(i, draw.randrange(0, 9)) for i in range(500)] + [row(500, 8, 9, **plain)]
    # day 3 closes with the second file, its rows there included; for the third file rows of day 5 are late, those of day 6 are not
    second = [row(i, draw.randrange(1, 13)) for i in range(501, 800)] + [row(800, 12, 9, **plain)]
    third = [row(i, draw.randrange(6, 16)) for i in range(801, 990)]
    third += [row(990, 6, 5, **{**plain, "account_id": "B"}), row(991, 7, -5, **plain), row(992, 30, 9, **plain)]
    late = [row(9000 + i, 5, 5, **plain) for i in range(3)]
    for part in (first, second, third + late):
        spark.createDataFrame([tuple(r.values()) for r in part], _order(part)).select(*ROW_NAMES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query, out = _run(spark, str(tmp_path / "in"), tmp_path, "out")
    assert sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"]) == len(late)
    whole = spark.read.schema(ROW).parquet(str(tmp_path / "in")).filter("id < '9000'")
    found = out.filter("partner_id IS NOT NULL")
    expected = whole.sparkSession.sql(PAIRS, rows=whole)
    assert found.exceptAll(expected).count() == 0 == expected.exceptAll(found).count()
    assert {r["tier"] for r in found.select("tier").collect()} == {1, 2, 3}
    # the batch job too, where every row has an account
    known = transfer_candidates(whole.filter("account_id IS NOT NULL"))
    assert known.count() > 100 and known.exceptAll(expected).count() == 0 == expected.exceptAll(known).count()
    # all active rows leave but those of the last day
    usable = whole.filter("amount <> 0 AND NOT is_deleted AND NOT is_infrastructure AND NOT is_contra AND status IN ('approved', 'pending_review')")
    ids = out.select("id")
    assert ids.count() == ids.distinct().count() and ids.exceptAll(usable.filter("id <> '0992'").select("id")).count() == 0
    assert usable.count() == ids.count() + 1


ROW_NAMES = [part.split()[0] for part in ROW.replace("38,2", "").split(", ")]


def _order(part):
    types = {c.split()[0]: c for c in ROW.replace("decimal(38,2)", "int").split(", ")}
    return ", ".join(types[name] for name in part[0])


class Store(dict):
    """Keyed state of one key, which counts the chunks that are read."""

    def getValue(self, key):
        self.read = getattr(self, "read", 0) + 1
        return self.get(key)

    updateValue, removeKey = dict.__setitem__, dict.__delitem__


class Place:
    value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


@pytest.fixture
def keyed():
    chunks, place, timers = Store(), Place(), []
    processor = ClosedDays()
    processor.init(SimpleNamespace(getMapState=lambda *_: chunks, getValueState=lambda *_: place, registerTimer=timers.append))
    return processor, chunks, place, timers


def test_a_group_of_many_rows_leaves_in_chunks(keyed, monkeypatch):
    """One user's one amount on three days: a chunk is read at a time, first rows are enough for all, and the state empties."""
    monkeypatch.setattr(counterparts, "CHUNK_ROWS", 1000)
    processor, chunks, place, timers = keyed
    row = lambda i, sign: f'["{i:06d}","u","5.00","{sign}","{"A" if sign == "1" else "B"}",null,"{i}","approved"]'
    days = [100, 101, 102]
    frames = (
        pd.DataFrame({"day": [days[i % 3] for i in ids], "packed": [row(i, "1" if i % 2 else "-1") for i in ids]})
        for ids in (range(k, k + 500) for k in range(0, 12_000, 500))
    )
    list(processor.handleInputRows((0,), frames, None))
    assert len(chunks) == 36 and timers == [(100 + 3) * counterparts.DAY_MS]
    fire = lambda day: list(
        processor.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: day * counterparts.DAY_MS), None)
    )
    first = fire(104)  # days 100 and 101 are closed
    assert len(first) > 6 and all(len(f) <= 1400 for f in first)
    out = pd.concat(first)
    assert len(out) == 8000 == out["id"].nunique() and set(out["tier"]) == {2}
    # odd rows meet even ones of two or three days: the first of all for those of day 100 and 101
    assert set(out["partner_id"]) == {"000000", "000001"} and set(out["candidates"]) == {4000, 6000}
    assert {day for day, _ in chunks} == {101, 102} and timers[-1] == (102 + 3) * counterparts.DAY_MS
    assert fire(104) == []
    assert len(pd.concat(fire(105))) == 4000 and {day for day, _ in chunks} == {102}
    assert fire(106) == [] and not chunks and place.get() is None
    assert chunks.read <= 36 * 4
