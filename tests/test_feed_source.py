"""The paged feed as a data source against the table operators."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from briefloom.operators.ranking import take_while
from briefloom.functions import text as X
from briefloom.functions import values as V
from briefloom.sources import feeds
from briefloom.sources.feed_source import RecordedFeed

DAY = dt.date(2026, 3, 17)


def item(keyword, place, day=17):
    return {"title": f"{keyword} {place} 한", "pubDate": f"{dt.date(2026, 3, day):%a, %d %b %Y} 12:00:00 +0900" if day else "soon"}


def record(path, keyword, start, items):
    (path / str(keyword)).mkdir(parents=True, exist_ok=True)
    (path / str(keyword) / f"{start}.json").write_text(json.dumps(items), encoding="utf-8")


@pytest.fixture
def pages(tmp_path):
    """Full, short, missing and surplus pages, an empty one, and one after a gap."""
    path = tmp_path / "feed"
    sizes = {1: [100, 100, 30], 2: [100, 99, 100], 3: [100, None, 100], 4: [0], 5: [100] * 11, 6: [7]}
    for keyword, own in sizes.items():
        for n, size in enumerate(own):
            if size is not None:
                record(path, keyword, 100 * n + 1, [item(keyword, 100 * n + k, 18 if k < 3 and not n else 16 if n == 1 and k > 20 else None if k % 9 == 0 else 17) for k in range(size)])
    (path / "notes").mkdir()
    return path


@pytest.fixture
def feed(spark, pages):
    spark.dataSource.register(RecordedFeed)
    return spark.read.format("recorded_feed").option("path", str(pages))


def recorded(spark, pages):
    rows = [(int(p.parent.name), int(p.stem) - 1 + k, json.dumps(x, ensure_ascii=False)) for p in pages.glob("*/*.json") for k, x in enumerate(json.loads(p.read_text(encoding="utf-8")))]
    return spark.createDataFrame(rows, "keyword_id long, place long, item string")


def test_equals_what_is_served(spark, pages, feed):
    want = feeds.served(recorded(spark, pages)).select("keyword_id", "place", "item")
    got = feed.load()
    assert got.rdd.getNumPartitions() == 6
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 230 + 199 + 100 + 1000 + 7


def test_ends_at_the_first_older_item(spark, pages, feed):
    own = feeds.served(recorded(spark, pages)).withColumn("day", V.business_date(V.parse_pub_date(X.json_field(F.col("item"), "pubDate"))))
    want = take_while(own, ["keyword_id"], "place", F.col("day") < F.lit(DAY)).select("keyword_id", "place")
    got = feed.option("day", "2026-03-17").schema("keyword_id long, place long").load()
    assert got.columns == ["keyword_id", "place"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_reads_on_as_a_stream(spark, pages, feed, tmp_path):
    """New pages come in; each item is read once, also after a restart."""

    def run():
        stream = spark.readStream.format("recorded_feed").option("path", str(pages)).load()
        query = stream.writeStream.option("checkpointLocation", f"file://{tmp_path}/checkpoint").format("parquet").option("path", f"file://{tmp_path}/out").trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
        return sorted(map(tuple, spark.read.schema("keyword_id long, place long, item string").parquet(f"file://{tmp_path}/out").collect()))

    first = run()
    assert first == sorted(map(tuple, feed.load().collect()))
    record(pages, 6, 1, [item(6, k) for k in range(100)])
    record(pages, 6, 101, [item(6, 100 + k) for k in range(4)])
    record(pages, 8, 1, [item(8, 0)])
    again = run()
    assert [r[:2] for r in again] == sorted([r[:2] for r in first] + [(6, k) for k in range(7, 104)] + [(8, 0)])


def test_nothing_recorded(spark, feed, tmp_path):
    assert spark.read.format("recorded_feed").option("path", str(tmp_path / "none")).load().count() == 0
    with pytest.raises(Exception, match="no columns"):
        feed.schema("keyword_id long, other string").load().count()
