"""Rows that wait for a counterpart: packed by day in keyed state until the days about them are closed."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from heapq import nsmallest

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallymill.operators.dedup import ACTIVE
from tallymill.streaming.pairing import DAY_MS, PROVIDER, ROCKS

#: Users and magnitudes are dealt to so many keys. A query that goes on from a checkpoint needs the number it began with.
PARTS = 1024
#: A key's rows are packed at the latest when so many wait to be, and rows leave at the latest in such numbers.
CHUNK_ROWS = 50_000
#: A day leaves when the watermark is past the end of the next day, and one more.
CLOSES_AFTER = 3
#: What a packed row holds, all as text.
PACKED = ["id", "user_id", "magnitude", "sign", "account_id", "ref_number", "created_us", "status"]
FOUND = "id string, user_id string, candidates bigint, tier int, partner_id string"
COLUMNS = [part.split()[0] for part in FOUND.split(", ")]
OPPOSITE = {"1": "-1", "-1": "1"}
#: The state of all partitions of an executor shares one bounded cache.
STATE = {PROVIDER: ROCKS, "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true"}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB; others of the session keep the provider they had."""
    before = {name: spark.conf.get(name, None) for name in STATE}
    try:
        for name, value in STATE.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def pack(rows: list[str]) -> bytes:
    return zlib.compress(f"[{','.join(rows)}]".encode(), 1)


def unpack(packed: bytes) -> list[list[str | None]]:
    return json.loads(zlib.decompress(packed))


def _head(row_id: str | None, created_us: str | None) -> tuple:
    """Order of rows by time and id, nulls first."""
    return (float("-inf") if created_us is None else int(created_us), row_id is not None, row_id)


class Heads:
    """The first rows of a day by user, magnitude, sign and account (for tier 1 and reference), and how many of them are active."""

    def __init__(self) -> None:
        self.cells: dict[tuple, dict[str, list]] = {}
        self.least: dict[tuple, tuple] = {}

    def add(self, rows: list[list[str | None]]) -> None:
        cells = self.cells
        for row_id, user, magnitude, sign, account, ref, created, status in rows:
            if user is None or account is None:
                continue
            head = _head(row_id, created)
            if status in ACTIVE:
                keys = [(user, magnitude, sign)] if ref is None else [(user, magnitude, sign), (user, magnitude, sign, ref)]
            else:
                keys = [(user, magnitude, sign, None, status)]
            for key in keys:
                accounts = cells.get(key)
                if accounts is None:
                    accounts = cells[key] = {}
                cell = accounts.get(account)
                if cell is None:
                    accounts[account] = [1, head]
                else:
                    cell[0] += 1
                    if head < cell[1]:
                        cell[1] = head

    def beside(self, key: tuple, account: str) -> tuple[int, tuple | None]:
        """Rows under the key that are of another account: how many, and the first. The heads of two accounts are enough to tell."""
        accounts = self.cells.get(key)
        if accounts is None:
            return 0, None
        if key not in self.least:
            total = sum(n for n, _ in accounts.values())
            self.least[key] = total, nsmallest(2, ((head, name) for name, (_, head) in accounts.items()))
        total, two = self.least[key]
        own = accounts.get(account)
        return total - (own[0] if own else 0), next((head for head, name in two if name != account), None)


def counterpart(row: list[str | None], days: list[Heads]) -> tuple[int, int | None, str | None]:
    """Number of active candidates of a row, and tier and id of its counterpart, if any."""
    _, user, magnitude, sign, account, ref, _, _ = row
    if user is None or account is None:
        return 0, None, None
    key = (user, magnitude, OPPOSITE[sign])
    met = [heads.beside(key, account) for heads in days]
    candidates = sum(n for n, _ in met)
    if candidates:
        if ref is not None:
            firsts = [head for _, head in (heads.beside((*key, ref), account) for heads in days) if head]
            if firsts:
                return candidates, 1, min(firsts)[2]
        return candidates, 2, min(head for _, head in met if head)[2]
    reviewed = (*key, None, "user_reviewed")
    firsts = [head for _, head in (heads.beside(reviewed, account) for heads in days) if head]
    return (0, 3, min(firsts)[2]) if firsts else (0, None, None)


class ClosedDays(StatefulProcessor):
    """Holds the rows of some users and magnitudes, packed by day. When no row can come any more that a day's rows could meet, they
    leave, each with its counterpart or none. Of a key, the first rows of three days, one chunk and as many rows that leave are in
    memory at a time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "day int, number int", "packed binary")
        # the number of the next chunk, and the last day that has left
        self.place = handle.getValueState("place", "number int, closed int")

    def _wake(self, day: int) -> None:
        self.handle.registerTimer((day + CLOSES_AFTER) * DAY_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number, closed = self.place.get() or (0, None)
        days: set[int] = set()
        waiting: dict[int, list[str]] = {}
        n = 0

        def store() -> None:
            for day, packed in waiting.items():
                self.chunks.updateValue((day, number), (pack(packed),))
            days.update(waiting)

        for frame in rows:
            for day, row in zip(frame["day"].tolist(), frame["packed"].tolist()):
                waiting.setdefault(day, []).append(row)
            n += len(frame)
            if n >= CHUNK_ROWS:
                store()
                waiting, n, number = {}, 0, number + 1
        store()
        self.place.update((number + 1, closed))
        self._wake(min(days))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = self.place.get()
        if found is None:
            return
        number, before = found
        closed = timerValues.getCurrentWatermarkInMs() // DAY_MS - CLOSES_AFTER
        held: dict[int, list[int]] = {}
        for day, chunk in self.chunks.keys():
            held.setdefault(day, []).append(chunk)
        heads: dict[int, Heads] = {}
        out: list[tuple] = []
        for day in sorted(d for d in held if d <= closed and (before is None or d > before)):
            heads = {d: heads[d] if d in heads else self._heads(d, held.get(d, [])) for d in (day - 1, day, day + 1)}
            near = list(heads.values())
            for chunk in held[day]:
                out += [(*row[:2], *counterpart(row, near)) for row in self._rows(day, chunk) if row[-1] in ACTIVE]
                if len(out) >= CHUNK_ROWS:
                    yield self._frame(out)
                    out = []
        if out:
            yield self._frame(out)
        # the last closed day can still be met by the next one
        for day in [d for d in held if d < closed]:
            for chunk in held.pop(day):
                self.chunks.removeKey((day, chunk))
        if held:
            self.place.update((number, closed))
            self._wake(min(max(d, closed + 1) for d in held))
        else:
            self.place.clear()

    def _rows(self, day: int, chunk: int) -> list[list[str | None]]:
        return unpack(self.chunks.getValue((day, chunk))[0])

    def _heads(self, day: int, chunks: list[int]) -> Heads:
        heads = Heads()
        for chunk in chunks:
            heads.add(self._rows(day, chunk))
        return heads

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=COLUMNS)
        return frame.assign(tier=pd.array([row[COLUMNS.index("tier")] for row in out], dtype="Int32"))

    def close(self) -> None:
        pass
