"""Keyed state across micro-batches: a feed's stop flag, and keys seen before.

However a feed's items are split into micro-batches, and in whatever order they come, what is
let through is what the batch query over all of them gives.  State is kept by Spark in
RocksDB, by key, and is restored from the checkpoint.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from briefloom.functions import text as X
from briefloom.functions import values as V
from briefloom.sources.feeds import LAST_START, PAGE_SIZE

#: Places of a feed that can be served.
PLACES = (LAST_START - 1) // PAGE_SIZE * PAGE_SIZE + PAGE_SIZE
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def use_state_store(spark: SparkSession) -> None:
    """Keep state in RocksDB, which keyed processors need; for queries started from now on."""
    spark.conf.set(*STATE_STORE)


class TakeWhile(StatefulProcessor):
    """A keyword's items in the order of their places, until the first of a day before ``day``.

    Items that come ahead of their turn wait in state, at most as many as a feed serves;
    a place that came before is passed over.
    """

    def __init__(self, day: dt.date):
        self.day = day

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "next long, stopped boolean")
        self.waiting = handle.getMapState("waiting", "place long", "item string, day date")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, stopped = self.at.get() if self.at.exists() else (0, False)
        out = []
        for batch in rows:
            for place, item, day in zip(batch["place"], batch["item"], batch["day"]):
                if not stopped and place >= at and not self.waiting.containsKey((int(place),)):
                    self.waiting.updateValue((int(place),), (item, None if pd.isna(day) else day))
        while not stopped and self.waiting.containsKey((at,)):
            item, day = self.waiting.getValue((at,))
            self.waiting.removeKey((at,))
            if day is not None and day < self.day:
                stopped = True
                self.waiting.clear()
            elif day == self.day:
                out.append((int(key[0]), at, item))
            at += not stopped
        self.at.update((at, stopped))
        yield pd.DataFrame(out, columns=["keyword_id", "place", "item"])

    def close(self) -> None:
        pass


def items_of_day(items: DataFrame, day: dt.date) -> DataFrame:
    """Items of ``day`` out of a stream of ``(keyword_id, place, item)``, each keyword's up to its first older one.

    A feed numbers its items from 0 without gaps; behind a gap nothing is let through until it is
    filled, as paging ends there.  Items without a readable date are passed over.
    """
    published = V.parse_pub_date(X.json_field(F.col("item"), "pubDate"))
    own = items.where((F.col("place") >= 0) & (F.col("place") < PLACES)).select(
        F.col("keyword_id").cast("long"), F.col("place").cast("long"), "item", V.business_date(published).alias("day")
    )
    out = "keyword_id long, place long, item string"
    return own.groupBy("keyword_id").transformWithStateInPandas(TakeWhile(day), out, "Append", "None")


class FirstSeen(StatefulProcessor):
    """The first row of a key; a key is forgotten by a timer when nothing of it has come for ``horizon_ms``."""

    def __init__(self, time: str, horizon_ms: int):
        self.time, self.horizon_ms = time, horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, last = None, 0
        for batch in rows:
            own = batch.sort_values(self.time, kind="stable")
            if first is None or own[self.time].iloc[0] < first[self.time].iloc[0]:
                first = own.iloc[:1]
            last = max(last, int(own[self.time].iloc[-1].timestamp() * 1000))
        at = last + self.horizon_ms
        if self.timer.exists():
            before = self.timer.get()[0]
            self.handle.deleteTimer(before)
            at = max(at, before)
        else:
            yield first
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_seen(stream: DataFrame, keys: list[str], time: str, horizon_ms: int, delay: str = "1 hour") -> DataFrame:
    """A key's first row, whichever micro-batch it comes in, unless the key was seen within the horizon before.

    ``time`` is when a row arrived; rows without it are left out, and rows that arrived more than
    ``delay`` before the newest one of an earlier micro-batch are late, which Spark drops.
    """
    own = stream.where(F.col(time).isNotNull()).withWatermark(time, delay)
    return own.groupBy(*keys).transformWithStateInPandas(FirstSeen(time, horizon_ms), StructType(stream.schema.fields), "Append", "EventTime")
