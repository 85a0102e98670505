"""Debouncing: a key's changes are put out once, when the key has been quiet for a time."""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STATE = "first timestamp, last timestamp, n bigint, newest string"


class Quiet(StatefulProcessor):
    """State and one timer for each key: the burst so far, and the moment at which it ends if nothing comes."""

    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.burst = handle.getValueState("burst", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pieces = [self.burst.get()] if self.burst.exists() else []
        quiet, out = pd.Timedelta(milliseconds=self.quiet_ms), []
        events = pd.concat([pdf[["at", "what"]] for pdf in rows]).sort_values(["at", "what"])
        first, last, n, newest = pieces[0] if pieces else (None, None, 0, None)
        for at, what in events.itertuples(index=False):
            if n and at - pd.Timestamp(last) >= quiet:  # the burst before had ended: both came in one batch
                out.append((key[0], first, last, n, newest))
                n = 0
            newest = what if not n or at >= pd.Timestamp(last) else newest
            first = at if not n else min(pd.Timestamp(first), at)
            last = at if not n else max(pd.Timestamp(last), at)
            n += 1
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        plain = lambda t: pd.Timestamp(t).to_pydatetime()
        self.burst.update((plain(first), plain(last), int(n), newest))
        # wall clocks apart: the timer runs on event time, which the watermark carries
        ends = pd.Timestamp(last).tz_localize("UTC") + quiet
        self.handle.registerTimer(int(ends.timestamp() * 1000))
        yield _rows(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.burst.exists():
            first, last, n, newest = self.burst.get()
            self.burst.clear()
            yield _rows([(key[0], first, last, n, newest)])

    def close(self) -> None:
        pass


def _rows(rows: list[tuple[Any, datetime.datetime, datetime.datetime, int, str]]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["key", "first", "last", "n", "newest"])
    return out.astype({"first": "datetime64[us]", "last": "datetime64[us]", "n": "int64"})


def debounced(events: DataFrame, key: str, at: str, what: str, quiet: str = "60 seconds", late: str = "0 seconds") -> DataFrame:
    """key, first, last, n and newest of each burst: the events of a key of which none follows
    ``quiet`` or more after the one before.

    On a stream a burst is put out once the watermark has passed its quiet time, by a timer of
    the key (``transformWithState``, so the state store must be RocksDB); on a table by sessions of the same
    gap. Null keys and times are left out; an empty table gives an empty table.
    """
    text = F.col(f"`{key}`").cast("string").alias("key")
    rows = events.select(text, F.col(f"`{at}`").alias("at"), F.col(f"`{what}`").cast("string").alias("what")).where("key is not null and at is not null")
    if not events.isStreaming:
        gap = F.col("at") >= F.lag("at").over(Window.partitionBy("key").orderBy("at")) + F.expr(f"interval {quiet}")
        burst = F.sum(F.when(gap, 1).otherwise(0)).over(Window.partitionBy("key").orderBy("at"))
        out = rows.withColumn("burst", burst).groupBy("key", "burst")
        return out.agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"), F.max_by("what", F.struct("at", "what")).alias("newest")).drop("burst")
    ms = int(pd.Timedelta(quiet).total_seconds() * 1000)
    schema = "key string, first timestamp, last timestamp, n bigint, newest string"
    marked = rows.withWatermark("at", late).groupBy("key")
    return marked.transformWithStateInPandas(Quiet(ms), schema, "append", "eventTime")
