"""A paged feed as a Spark data source, over recorded pages.

Every keyword is a partition.  Its reader asks for page after page, of 100 items each, as long as
they come full and within the feed's reach, so that a page that isn't full or is missing ends
the scan; with the option ``day`` it also ends at the first item of an earlier day.  Only
columns asked for are parsed.  As a stream the feed is read on from the place it had come to.

Pages are recorded as ``<path>/<keyword_id>/<start>.json``, an array of items, on a file
system that the driver and all executors see.
"""

from __future__ import annotations

import datetime as dt
import json
import os
from collections.abc import Iterator
from email.utils import parsedate_to_datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from briefloom.sources.feeds import LAST_START, PAGE_SIZE

SCHEMA = "keyword_id long, place long, item string"
FIELDS = ("keyword_id", "place", "item")


def starts() -> range:
    return range(1, LAST_START + 1, PAGE_SIZE)


def page(path: str, keyword: int, start: int) -> list | None:
    """A recorded page's items; None if it wasn't recorded."""
    at = os.path.join(path, str(keyword), f"{start}.json")
    if not os.path.exists(at):
        return None
    with open(at, encoding="utf-8") as f:
        return json.load(f)


def is_older(item: dict, day: dt.date | None) -> bool:
    """Whether an item's date, in UTC+9, is before ``day``; an unreadable one isn't."""
    if day is None:
        return False
    try:
        published = parsedate_to_datetime(item.get("pubDate") or "")
    except (TypeError, ValueError):
        return False
    return published.tzinfo is not None and published.astimezone(dt.timezone(dt.timedelta(hours=9))).date() < day


def served_items(path: str, keyword: int, day: dt.date | None, first: int = 0) -> Iterator[tuple[int, dict]]:
    """(place, item) of what paging reaches, from place ``first`` on."""
    for start in starts():
        items = page(path, keyword, start)
        for k, item in enumerate(items or []):
            if is_older(item, day):
                return
            if k < PAGE_SIZE and start - 1 + k >= first:
                yield start - 1 + k, item
        if items is None or len(items) < PAGE_SIZE:
            return


def keywords_of(path: str) -> list[int]:
    return sorted(int(k) for k in os.listdir(path) if k.isdigit()) if os.path.isdir(path) else []


class Keyword(InputPartition):
    def __init__(self, keyword: int, first: int = 0, end: int | None = None):
        self.keyword, self.first, self.end = keyword, first, end


class _Pages:
    """What both readers share: options, columns, rows."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.columns = options["path"].removeprefix("file://"), schema.names
        self.day = dt.date.fromisoformat(options["day"]) if "day" in options else None
        if unknown := set(self.columns) - set(FIELDS):
            raise ValueError(f"a feed has no columns {sorted(unknown)}")

    def rows(self, part: Keyword) -> Iterator[tuple]:
        for place, item in served_items(self.path, part.keyword, self.day, part.first):
            if part.end is not None and place >= part.end:
                return
            made = {"keyword_id": lambda: part.keyword, "place": lambda: place, "item": lambda: json.dumps(item, ensure_ascii=False)}
            yield tuple(made[c]() for c in self.columns)


class FeedReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Keyword]:
        return [Keyword(k) for k in keywords_of(self.path)] or [Keyword(-1)]

    def read(self, partition: Keyword) -> Iterator[tuple]:
        return self.rows(partition)


class FeedStream(_Pages, DataSourceStreamReader):
    """Offsets are the places each keyword has come to."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {str(k): 1 + max((place for place, _ in served_items(self.path, k, self.day)), default=-1) for k in keywords_of(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Keyword]:
        return [Keyword(int(k), start.get(k, 0), n) for k, n in end.items() if n > start.get(k, 0)]

    def read(self, partition: Keyword) -> Iterator[tuple]:
        return self.rows(partition)


class RecordedFeed(DataSource):
    """``spark.dataSource.register(RecordedFeed)``, then ``spark.read.format("recorded_feed").option("path", ...)``.

    ``schema("place long, keyword_id long")`` reads these columns only.
    """

    @classmethod
    def name(cls) -> str:
        return "recorded_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FeedReader:
        return FeedReader(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> FeedStream:
        return FeedStream(dict(self.options), schema)
