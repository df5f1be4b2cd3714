"""Streams with keyed state and timers: a login throttle, and silences told while they last.

Both use one state per key that ends by itself, so that keys which are never seen again
cost nothing after their time is over. On the event clock a timer removes it once the
watermark has passed; on the wall clock the state store's time to live does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import workers_find_us

#: The state store that arbitrary state needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(times: pd.Series) -> list[int]:
    return times.dt.as_unit("us").astype("int64").tolist()


def _frame(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(order, kind="stable")


def refuse(failures: list[int], until: int, at: int, ok: bool, limit: int, window: int, lock: int) -> tuple[list[int], int, bool]:
    """The next state, and whether this attempt is refused. All times in microseconds.

    ``limit`` failures within ``window`` lock until ``lock`` later; attempts under the
    lock are refused and count nothing; a success forgets the failures.
    """
    if at < until:
        return failures, until, True
    if ok:
        return [], 0, False
    recent = [t for t in failures if at - t <= window] + [at]
    return ([], at + lock, False) if len(recent) >= limit else (recent, 0, False)


class _Throttle(StatefulProcessor):
    def __init__(self, key: str, limit: int, window: int, lock: int, wall_clock: bool):
        self.key, self.limit, self.window, self.lock, self.wall_clock = key, limit, window, lock, wall_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = -(-max(self.window, self.lock) // 1000) if self.wall_clock else None
        self.failures = handle.getListState("failures", "at long", ttlDurationMs=ttl)
        self.until = handle.getValueState("until", "at long", ttlDurationMs=ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        failures = [x[0] for x in self.failures.get()] if self.failures.exists() else []
        until = self.until.get()[0] if self.until.exists() else 0
        own = _frame(rows, ["ts", "attempt"])
        refused = []
        for at, ok in zip(_micros(own["ts"]), own["ok"]):
            failures, until, no = refuse(failures, until, at, bool(ok), self.limit, self.window, self.lock)
            refused.append(no)
        self._keep(failures, until, None if self.wall_clock else timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({self.key: pd.Series([key[0]] * len(own), dtype=object), "attempt": own["attempt"].to_numpy(), "refused": refused})

    def _keep(self, failures: list[int], until: int, watermark: int | None) -> None:
        """State for as long as it can matter: the last failure's window, or the lock."""
        for timer in list(self.handle.listTimers()) if watermark is not None else []:
            self.handle.deleteTimer(timer)
        ends = max([until, *(t + self.window for t in failures)]) // 1000 + 1
        if not failures and not until or watermark is not None and ends <= watermark:
            self.failures.clear()
            self.until.clear()
            return
        if failures:
            self.failures.put([(t,) for t in failures])
        else:
            self.failures.clear()
        self.until.update((until,))
        if watermark is not None:
            self.handle.registerTimer(ends)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.failures.clear()
        self.until.clear()
        return iter([])

    def close(self) -> None:
        pass


def throttled(attempts: DataFrame, key: str = "address", limit: int = 8, window: float = 300, lock: float = 300, delay: str = "1 minute", wall_clock: bool = False) -> DataFrame:
    """key, attempt, refused: a row for each attempt of the stream. attempts: key (long or string), attempt (its id), ts, ok.

    Attempts of one key are taken in the order (ts, attempt) within a micro-batch, and
    batches in theirs. On the event clock ``delay`` is how late an attempt may come.
    """
    workers_find_us(attempts.sparkSession)
    kind = attempts.schema[key].dataType.simpleString()
    own = attempts if wall_clock else attempts.withWatermark("ts", delay)
    step = _Throttle(key, limit, int(window * 1e6), int(lock * 1e6), wall_clock)
    return own.groupBy(key).transformWithStateInPandas(step, f"{key} {kind}, attempt long, refused boolean", "append", "ProcessingTime" if wall_clock else "EventTime")


class _Silence(StatefulProcessor):
    def __init__(self, key: str, limit: int):
        self.key, self.limit = key, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def _told(self, key, lasts: list[int]) -> pd.DataFrame:
        return pd.DataFrame({self.key: pd.Series([key[0]] * len(lasts), dtype=object), "last_seen": pd.to_datetime(lasts, unit="us")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(t for r in rows for t in _micros(r["ts"]))
        if self.last.exists():
            times = sorted([self.last.get()[0], *times])
        if over := [a for a, b in zip(times, times[1:]) if b - a > self.limit]:
            yield self._told(key, over)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        ends = (times[-1] + self.limit) // 1000 + 1
        if ends <= timerValues.getCurrentWatermarkInMs():
            yield self._told(key, times[-1:])
            self.last.clear()
        else:
            self.last.update((times[-1],))
            self.handle.registerTimer(ends)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            yield self._told(key, [self.last.get()[0]])
            self.last.clear()

    def close(self) -> None:
        pass


def silences(rows: DataFrame, key: str, seconds: float, delay: str = "0 seconds") -> DataFrame:
    """key, last_seen: told once for each row after which its key says nothing for longer than that.

    A silence that a later row ends is told with that row at the latest; one that lasts is
    told as soon as the watermark, which other keys' rows move, has passed its limit.
    rows: key, ts.
    """
    workers_find_us(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()
    own = rows.select(key, "ts").withWatermark("ts", delay)
    return own.groupBy(key).transformWithStateInPandas(_Silence(key, int(seconds * 1e6)), f"{key} {kind}, last_seen timestamp", "append", "EventTime")


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that the stream gives for what is there now, written to the path and read again. Not for wall-clock streams, which never end by themselves."""
    spark = stream.sparkSession
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        if old is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    return spark.read.schema(stream.schema).parquet(path)
