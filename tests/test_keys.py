"""Key tables with Bloom filters against the whole history."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from briefloom.sources import keys as K
from briefloom.sources.store import Tables

NOW = dt.datetime(2026, 3, 18, 6)


def raw(spark, ids, day=dt.date(2026, 3, 17)):
    rows = [(i, "FEED", f"k{i}", "US", day, f"t{i}", "{}", NOW, NOW) for i in ids]
    df = spark.createDataFrame(rows, "id long, provider_name string, provider_article_key string, market_type string, business_date date, title string, payload_json string, collected_at timestamp, created_at timestamp")
    return df.withColumns({c: F.lit(None).cast("string") for c in ("search_keyword", "publisher_name", "origin_link", "naver_link")}).withColumn("published_at", F.lit(None).cast("timestamp"))


def test_unknown_rows_are_those_the_history_lacks(spark, tmp_path, monkeypatch):
    """In several appends, past the size filters are made for; only buckets that may hold a key are read."""
    monkeypatch.setattr(K, "LEAST", 16)
    t = Tables(spark, f"file://{tmp_path}/store")
    for at in range(0, 3000, 1000):
        t.append("news_article_raw", raw(spark, range(at, at + 1000)))
    filters = t.read("raw_key_filter").collect()
    assert sum(r.n for r in filters) == 3000 and all(r.n <= r.made_for for r in filters) and len(filters) == K.BUCKETS
    asked = raw(spark, [5, 2999, *range(3000, 3200), 5])
    assert sorted(r.id for r in t.unknown("news_article_raw", asked).collect()) == list(range(3000, 3200))
    assert sorted(tuple(r) for r in t.known_ids("news_article_raw", asked).collect()) == [("FEED", "k2999", 2999), ("FEED", "k5", 5)]
    read, real = [], Tables.read

    def seen(self, name, within=None):
        if name == "raw_key":
            read.append(list(within))
        return real(self, name, within)

    monkeypatch.setattr(Tables, "read", seen)
    t.unknown("news_article_raw", asked).count()
    assert len(read[0]) <= 4  # two known keys, and hardly a false one among 200
    t.unknown("news_article_raw", raw(spark, [])).count()
    assert read[1] == []


def test_no_key_is_missed(spark):
    keys = spark.range(20_000).select(K.key_of([F.col("id").cast("string")]).alias("key")).withColumn("bucket", K.bucket_of(F.col("key"), 8))
    none = spark.createDataFrame([], K.FILTER_COLUMNS)
    filters = K.filters_with(none, keys, [])
    assert K.may_hold(filters, keys).count() == 20_000
    others = spark.range(100_000, 200_000).select(K.key_of([F.col("id").cast("string")]).alias("key")).withColumn("bucket", K.bucket_of(F.col("key"), 8))
    assert K.may_hold(filters, others).count() < 30


def test_overwritten_tables_have_their_keys_anew(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}/store")
    t.append("news_article_raw", raw(spark, [1, 2]))
    t.overwrite("news_article_raw", raw(spark, [2, 3]))
    assert sorted(r.id for r in t.unknown("news_article_raw", raw(spark, [1, 2, 3, 4])).collect()) == [1, 4]
    with pytest.raises(ValueError):
        t.replace("news_article_raw", raw(spark, [1]), [dt.date(2026, 3, 17)])
    null = raw(spark, [9]).withColumn("provider_article_key", F.lit(None).cast("string"))
    assert t.unknown("news_article_raw", null).count() == 1


def test_keys_stream_past_their_filters(spark):
    """No bucket is handed to Python whole: buckets of many batches, filters that are kept, outgrown, new and missing."""
    keys = spark.range(4000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id") % 3 + 1).cast("int").alias("bucket"), "id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        none = spark.createDataFrame([], K.FILTER_COLUMNS)
        old = K.filters_with(none, keys.where("id < 1000"), []).localCheckpoint()
        new = K.filters_with(old.where("bucket < 3"), keys.where("id >= 1000 or bucket = 0"), [0])
        passed = K.may_hold(new.where("bucket <> 2"), keys)
        for df in (new, passed):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "MapInPandas" in plan and "CoGroup" not in plan
        assert {r.bucket: (r.made_for, r.n) for r in old.collect()} == {0: (2048, 900), 1: (1024, 34), 2: (1024, 33), 3: (1024, 33)}
        assert {r.bucket: (r.made_for, r.n) for r in new.collect()} == {0: (8192, 3600), 1: (1024, 134), 2: (1024, 133), 3: (1024, 100)}
        got, of = {r.key for r in passed.collect()}, {r.key: (r.bucket, r.id) for r in keys.collect()}
        assert got == {k for k, (b, i) in of.items() if b in (0, 1) or b == 3 and i >= 1000}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
