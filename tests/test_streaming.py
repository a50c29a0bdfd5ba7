"""Keyed state across micro-batches against the batch queries."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from briefloom.operators.ranking import take_while
from briefloom.functions import text as X
from briefloom.functions import values as V
from briefloom.streaming import stateful

DAY = dt.date(2026, 3, 17)
ITEMS = "keyword_id long, place int, item string"


def items():
    """Per keyword newer items, unreadable dates, items of the day, an older one, and items of the day behind it."""
    r, out = random.Random(1), []
    for k in range(4):
        days = sorted((r.choice([18, 17, 17, 17]) for _ in range(12)), reverse=True) + [16] * (k != 2) + [17, 16, 17]
        for place, d in enumerate(days):
            date = "soon" if r.random() < 0.1 else dt.datetime(2026, 3, d, 12).strftime("%a, %d %b %Y %H:%M:%S +0900")
            out.append((k, place, json.dumps({"title": f"{k} {place}", "pubDate": date})))
    return out


def batch_query(spark, rows):
    day = V.business_date(V.parse_pub_date(X.json_field(F.col("item"), "pubDate")))
    own = spark.createDataFrame(rows, ITEMS).withColumn("day", day).where("day is not null")
    kept = take_while(own, ["keyword_id"], "place", F.col("day") < F.lit(DAY)).where(F.col("day") == F.lit(DAY))
    return sorted(tuple(r) for r in kept.select("keyword_id", "place", "item").collect())


def put(spark, rows, folder, n):
    spark.createDataFrame(rows, ITEMS).coalesce(1).write.parquet(f"{folder}/in/{n}")


def run(spark, folder, make):
    """All micro-batches that are there, each file one; resumed from the checkpoint."""
    stream = spark.readStream.schema(ITEMS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    writer = make(stream).writeStream.option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").format("parquet").outputMode("append")
    query = writer.trigger(availableNow=True).start()
    assert query.awaitTermination(120) and query.exception() is None


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(stateful.STATE_STORE[0])
    stateful.use_state_store(spark)
    yield
    spark.conf.set(stateful.STATE_STORE[0], before)


@pytest.mark.parametrize("seed, pieces", [(0, 1), (1, 3), (2, 5)])
def test_any_split_gives_what_the_batch_gives(spark, tmp_path, rocks, seed, pieces):
    """In any order and split, with repeated items, and stopped and resumed half-way."""
    rows, r, folder = items(), random.Random(seed), f"file://{tmp_path}"
    want = batch_query(spark, rows)
    mixed = rows + r.sample(rows, 10)
    r.shuffle(mixed)
    parts = [mixed[k::pieces] for k in range(pieces)]
    for n, part in enumerate(parts):
        put(spark, part, folder, n)
        if n == pieces // 2:
            run(spark, folder, lambda s: stateful.items_of_day(s, DAY))
    run(spark, folder, lambda s: stateful.items_of_day(s, DAY))
    got = spark.read.schema("keyword_id long, place long, item string").parquet(f"{folder}/out").collect()
    assert sorted(map(tuple, got)) == want and len(want) > 10


TIMED = "key long, n int, at timestamp"


def first_of(spark, folder, *batches):
    """What each micro-batch lets through, the query stopped and resumed after each."""
    out = []
    for n, rows in enumerate(batches):
        spark.createDataFrame([(k, i, dt.datetime(2026, 3, 17, h)) for k, i, h in rows], TIMED).coalesce(1).write.parquet(f"{folder}/in/{n}")
        stream = spark.readStream.schema(TIMED).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        kept = stateful.first_seen(stream, ["key"], "at", 3 * 3_600_000)
        query = kept.writeStream.option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").format("parquet").trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
        got = {(r.key, r.n) for r in spark.read.schema(TIMED).parquet(f"{folder}/out").collect()}
        out.append(got - set().union(*out))
    return out


def test_keys_seen_before_are_passed_over(spark, tmp_path, rocks):
    """Also after a restart; the earliest row of a micro-batch is let through; a key is let through again after its horizon."""
    got = first_of(spark, f"file://{tmp_path}", [(1, 1, 2), (1, 0, 1), (2, 0, 1)], [(1, 2, 3), (3, 0, 3)], [(9, 0, 20)], [(1, 3, 20), (2, 1, 20), (9, 1, 20)])
    assert got == [{(1, 0), (2, 0)}, {(3, 0)}, {(9, 0)}, {(1, 3), (2, 1)}]
