"""As-of joins in ranges against a plain model."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from briefloom.operators.asof import as_of_each

SERIES = "key string, on timestamp, n int, value double"
ASKED = "key string, at timestamp, row int, value string"


def model(asked, series):
    out = []
    for k, at, row, x in asked:
        own = sorted((t, n, v) for key, t, n, v in series if key is not None and t is not None and key == k and at is not None and t <= at)
        last = own[-1] if own else (None, None, None)
        before = own[-2] if len(own) > 1 else (None, None, None)
        out.append((k, at, row, x, last[1], last[2], before[1], before[2]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", ["1", "4", "23"])
def test_equals_model(spark, parts):
    """One hot key over many ranges, keys without a series, ties, questions before all and behind all, nulls."""
    r = random.Random(int(parts))
    time = lambda: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=r.randrange(400))
    key = lambda: r.choice(["hot", "hot", "hot", "a", "b", "c", None])
    series = [(k, time() if r.random() < 0.97 else None, n, r.choice([None, 1.0, 2.5])) for n, k in enumerate(key() for _ in range(250)) if k != "c"]
    asked = [(key(), time() if r.random() < 0.97 else None, i, "x") for i in range(200)] + [("hot", dt.datetime(2025, 1, 1), 900, None), ("hot", dt.datetime(2027, 1, 1), 901, None), ("none", dt.datetime(2027, 1, 1), 902, "x")]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        a = spark.createDataFrame(asked, ASKED).withColumnRenamed("value", "note")
        got = as_of_each(a, spark.createDataFrame(series, SERIES), "key", "at", "on", ["n"], ["n", "value"])
        assert got.columns == ["key", "at", "row", "note", "n", "value", "previous_n", "previous_value"]
        assert sorted(map(tuple, got.collect()), key=repr) == model(asked, series)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_a_hot_key_is_in_several_tasks(spark):
    from briefloom.operators import asof

    seen, real = [], asof._carried
    try:
        asof._carried = lambda both: seen.append(both) or real(both)
        series = spark.range(50_000).select(F.lit("k").alias("key"), F.timestamp_seconds("id").alias("on"), F.col("id").alias("n"))
        asked = spark.range(1000).select(F.lit("k").alias("key"), F.timestamp_seconds(F.col("id") * 49).alias("at"))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = as_of_each(asked, series, "key", "at", "on", ["n"], ["n"])
        assert got.where("unix_timestamp(at) <> n or previous_n <> n - 1").count() == 0 and got.count() == 1000
        assert seen[0].select("part").distinct().count() == 4
    finally:
        asof._carried = real
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_sides(spark):
    series, asked = spark.createDataFrame([], SERIES), spark.createDataFrame([("a", dt.datetime(2026, 1, 1), 1, "x")], ASKED).withColumnRenamed("value", "note")
    assert [tuple(r)[4:] for r in as_of_each(asked, series, "key", "at", "on", ["n"], ["n", "value"]).collect()] == [(None,) * 4]
    assert as_of_each(asked.limit(0), series, "key", "at", "on", ["n"], ["n"]).count() == 0
