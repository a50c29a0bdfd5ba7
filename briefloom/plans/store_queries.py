"""Queries that run the table store, deep pages, as-of joins and a whole day's batch over the driver's tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.functions import values as V
from briefloom.operators import lookup as L
from briefloom.operators import ranking as R
from briefloom.operators.asof import as_of_each
from briefloom.plans import steps
from briefloom.plans.registry import query, table
from briefloom.sources import feeds
from briefloom.sources import keys as K
from briefloom.sources import tables as S
from briefloom.sources.store import Tables

DAY = dt.date(2026, 3, 17)


def new_store(spark: SparkSession) -> Tables:
    """An empty store in the shared folder."""
    return Tables(spark, f"{S.shared_folder(spark).rstrip('/')}/briefloom-store/{uuid.uuid4().hex}")


@query("""SELECT MIN(doc_id) AS doc_id, sha256(text) AS text_hash FROM documents d WHERE text IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM documents h WHERE h.text = d.text AND h.doc_id % 10 = 0) GROUP BY text""")
def keys_unknown(spark, d):
    """Texts that a history ten times as large doesn't hold, by a key table and its filters."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    copies = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("n"), "text")
    past = copies.select(F.col("doc_id").alias("id"), F.when((F.col("n") == 0) & (F.col("doc_id") % 10 == 0), F.col("text")).otherwise(F.concat("text", F.lit("#"), "n")).alias("text"))
    keys = past.select(K.key_of(["text"]).alias("key"), "id").dropDuplicates(["key"]).withColumn("bucket", K.bucket_of(F.col("key")))
    t = new_store(spark)
    with t.transaction():
        K.add(t, "raw_key", S.staged(keys))
    first = R.first_per_key(docs, ["text"], [F.col("doc_id")])
    return K.unknown(t, "raw_key", first, ["text"]).select("doc_id", F.sha2("text", 256).alias("text_hash"))


@query("SELECT row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS place, o_orderkey FROM orders ORDER BY place LIMIT 2 OFFSET 9998")
def deep_page(spark, d):
    """Page 5,000; the page is the feature."""
    page = R.deep_page(table(spark, d, "orders").select("o_orderdate", "o_orderkey"), [("o_orderdate", False), ("o_orderkey", False)], 5000, 2, 1000)
    return S.in_place(page, "place").select((F.col("place") + 9998).alias("place"), "o_orderkey")


_SERIES = """WITH s AS (SELECT event_type, ts, event_id, value, lag(value) OVER w AS before, row_number() OVER (PARTITION BY event_type, ts ORDER BY event_id DESC) AS n
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)), a AS (SELECT DISTINCT event_type, CAST(CAST(ts AS DATE) + INTERVAL 1 DAY AS TIMESTAMP) AS at FROM events)"""


@query(f"""{_SERIES} SELECT a.event_type, a.at, s.event_id, s.value, s.before AS previous_value FROM a ASOF JOIN s ON a.event_type = s.event_type AND a.at >= s.ts WHERE true""".replace(
    "FROM a ASOF JOIN s", "FROM a ASOF JOIN (SELECT * FROM s WHERE n = 1) s").replace(" WHERE true", ""))
def asof_all_days(spark, d):
    """Each type's last value before the end of each day, and the one before; a handful of types, each a hot key."""
    e = table(spark, d, "events").select("event_type", "ts", "event_id", "value")
    asked = e.select("event_type", (F.date_add(F.to_date("ts"), 1)).cast(e.schema["ts"].dataType).alias("at")).distinct()
    return as_of_each(asked, e, "event_type", "at", "ts", ["event_id"], ["event_id", "value"]).drop("previous_event_id")


@query("""WITH s AS (SELECT user_id, ts, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS n FROM events),
a AS (SELECT event_id AS asked_id, user_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS at FROM events)
SELECT a.asked_id, a.user_id, s.event_id, s.value, s.before AS previous_value FROM a ASOF LEFT JOIN (SELECT * FROM s WHERE n = 1) s ON a.user_id = s.user_id AND a.at >= s.ts""")
def asof_all_events(spark, d):
    """For every event its user's last value before that day, and the one before; events without any are kept."""
    e = table(spark, d, "events")
    asked = e.select(F.col("event_id").alias("asked_id"), "user_id", F.to_date("ts").cast(e.schema["ts"].dataType).alias("at"))
    got = as_of_each(asked, e.select("user_id", "ts", "event_id", "value"), "user_id", "at", "ts", ["event_id"], ["event_id", "value"])
    return got.drop("at", "previous_event_id")


# A whole day ---------------------------------------------------------------------------------

#: Nations stand for keywords, documents for feed items, two for a story, events for prices.  A keyword's last fifth is of the day before; a feed serves 1,000.
_KEYWORDS = "SELECT CAST(n_nationkey AS BIGINT) AS id, CASE n_regionkey % 2 WHEN 0 THEN 'US' ELSE 'KR' END AS market_type, n_name AS keyword, n_nationkey % 5 > 0 AS is_active FROM nation"
_ITEMS = """SELECT doc_id, doc_id % 25 AS keyword_id, CAST(FLOOR(doc_id / 2) AS BIGINT) AS story, row_number() OVER (PARTITION BY doc_id % 25 ORDER BY doc_id) - 1 AS place,
COUNT(*) OVER (PARTITION BY doc_id % 25) AS n FROM documents"""
_PRICES = """SELECT event_id % 4 AS n, CAST(event_id % 8 AS INT) AS back, CAST(MAX(ROUND(value, 2)) AS DECIMAL(20, 4)) AS close FROM events WHERE value IS NOT NULL GROUP BY 1, 2"""
_HOUR = "CASE WHEN place * 5 >= n * 4 THEN -1 WHEN story % 7 = 0 THEN 99 WHEN story % 7 = 6 THEN 8 ELSE story % 7 END"


def day_inputs(spark: SparkSession, d: str) -> steps.Inputs:
    items = spark.sql(_ITEMS.replace("FROM documents", "FROM {t}"), t=table(spark, d, "documents")).withColumn("hour", F.expr(_HOUR))
    two = F.lpad(F.col("hour").cast("string"), 2, "0")
    date = (
        F.when(F.col("hour") == -1, "Mon, 16 Mar 2026 09:00:00 +0900").when(F.col("hour") == 99, "Wed, 18 Mar 2026 09:00:00 +0900")
        .otherwise(F.concat(F.lit("Tue, 17 Mar 2026 "), two, F.lit(":00:00 +0900")))
    )
    item = F.to_json(
        F.struct(
            F.concat(F.lit("<b>Story</b> "), "story", F.lit(" &amp; more")).alias("title"), F.concat(F.lit("http://N/"), "story", F.lit("/")).alias("originallink"),
            F.lit("").alias("link"), date.alias("pubDate"), F.concat(F.lit("Text "), "story").alias("description"),
        )
    )
    prices = spark.sql(_PRICES.replace("FROM events", "FROM {t}"), t=table(spark, d, "events"))
    tickers = spark.createDataFrame([(k, t[1]) for k, t in enumerate(feeds.TICKERS[:4])], "n long, ticker string")
    close = F.col("close").cast("double")
    history = prices.join(F.broadcast(tickers), "n").select("ticker", F.date_sub(F.lit(DAY), F.col("back")).alias("date"), close.alias("open"), close.alias("high"), close.alias("low"), close.alias("close"))
    return steps.Inputs(items=items.select("keyword_id", F.col("place").cast("int").alias("place"), item.alias("item")), history=history)


_DAY_SQL = f"""WITH k AS ({_KEYWORDS}), i AS (SELECT *, {_HOUR} AS hour FROM ({_ITEMS})),
taken AS (SELECT i.*, k.market_type, CASE k.market_type WHEN 'US' THEN 1 ELSE 2 END AS m FROM i JOIN k ON k.id = i.keyword_id AND k.is_active WHERE place * 5 < n * 4 AND place < 1000 AND hour <> 99),
raw AS (SELECT *, row_number() OVER (ORDER BY keyword_id, place) AS id FROM taken QUALIFY row_number() OVER (PARTITION BY story, hour ORDER BY keyword_id, place) = 1),
processed AS (SELECT *, 'Story ' || story || ' & more' AS title, 'Text ' || story AS summary FROM raw QUALIFY row_number() OVER (PARTITION BY story ORDER BY m, hour DESC, id) = 1),
member AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY hour DESC, id DESC) AS rank FROM processed),
cluster AS (SELECT m, MIN(title) FILTER (rank = 1) AS title, MIN(summary) FILTER (rank = 1) AS summary, COUNT(*) AS n FROM member GROUP BY m),
price AS ({_PRICES}), quote AS (SELECT n, close, lag(close) OVER (PARTITION BY n ORDER BY back DESC) AS before, back FROM price WHERE back <= 7 QUALIFY row_number() OVER (PARTITION BY n ORDER BY back) = 1),
late AS (SELECT COUNT(*) AS n FROM quote WHERE back > 0),
total AS (SELECT (SELECT COUNT(*) FROM raw) AS raw, (SELECT COUNT(*) FROM processed) AS processed, (SELECT COUNT(*) FROM cluster) AS clusters, (SELECT n FROM late) AS late),
step AS (SELECT unnest(['CREATE_JOB', 'COLLECT_NEWS', 'DEDUPE_ARTICLES', 'BUILD_CLUSTERS', 'COLLECT_INDICES', 'GENERATE_SUMMARIES', 'BUILD_SNAPSHOT', 'FINALIZE_JOB']) AS name, unnest(range(1, 9)) AS s),
told AS (SELECT 0 AS s, 0 AS k, 'CREATE_JOB|INFO|Batch job created.' AS v UNION ALL SELECT s, 0, name || '|INFO|Step started.' FROM step UNION ALL SELECT s, 9, name || '|INFO|Step completed.' FROM step
  UNION ALL SELECT 4, m, 'BUILD_CLUSTERS|INFO|Cluster created.' FROM cluster UNION ALL SELECT 6, 1, 'GENERATE_SUMMARIES|WARN|Summaries are fallbacks.'
  UNION ALL SELECT 7, 1, 'BUILD_SNAPSHOT|WARN|The page is partial.' FROM late WHERE n > 0 UNION ALL SELECT 8, 1, 'FINALIZE_JOB|INFO|Job ended as PARTIAL.')
SELECT 'job' AS part, 1 AS place, 'PARTIAL|' || raw || '|' || processed || '|' || clusters AS value FROM total
UNION ALL SELECT 'page', 1, 'V1|' || CASE WHEN late > 0 THEN 'PARTIAL' ELSE 'READY' END || '|' || (SELECT string_agg(title, ' / ' ORDER BY m) FROM cluster) || '|' || raw || '|' || processed || '|' || clusters FROM total
UNION ALL SELECT 'market', v.m, v.label || '|' || COALESCE(CASE v.m WHEN 1 THEN 'US' ELSE 'KR' END || ' 시장 핵심 이슈 요약|' || c.summary, '|') || '|' || CASE WHEN c.m IS NULL THEN 0 ELSE 1 END
  FROM (VALUES (1, '미국 증시 일간 요약'), (2, '한국 증시 일간 요약')) v(m, label) LEFT JOIN cluster c ON c.m = v.m
UNION ALL SELECT 'cluster', m, title || '|' || summary || '|' || n FROM cluster
UNION ALL SELECT 'link', 1000000 * m + rank, title || '|' || hour FROM member
UNION ALL SELECT 'quote', n, CAST(close AS VARCHAR) || '|' || CAST(CAST(close - COALESCE(before, close) AS DECIMAL(20, 4)) AS VARCHAR) FROM quote
UNION ALL SELECT 'event', row_number() OVER (ORDER BY s, k), v FROM told"""


@query(_DAY_SQL)
def daily_batch(spark, d):
    """S1, S2, S20, B1-B9, B7a-d, B8a, B8b, B11, B12, E6, E10, A7, A9: a day from its feed to its page, job and events, read back from the store."""
    t, now = new_store(spark), F.lit("2026-03-18 06:00:00").cast("timestamp")
    keywords = spark.sql(_KEYWORDS.replace("FROM nation", "FROM {t}"), t=table(spark, d, "nation"))
    t.append("news_search_keyword", keywords.withColumns({"provider_name": F.lit("FEED"), "priority": F.lit(1), "created_at": now, "updated_at": now}))
    c = steps.run_daily(t, steps.start_job(t, DAY), day_inputs(spark, d))
    joined = lambda *columns: F.concat_ws("|", *[F.coalesce(F.col(x).cast("string") if isinstance(x, str) else x, F.lit("")) for x in columns])
    row = lambda df, part, place, value: df.select(F.lit(part).alias("part"), place.cast("long").alias("place"), value.alias("value"))
    one = F.lit(1)
    job = L.by_value(t.read("batch_job", [DAY]), "job_id", c.job_id)
    page = t.read("market_daily_page", [DAY])
    markets = t.read("market_daily_page_market").select(F.col("id").alias("page_market_id"), F.col("display_order").alias("m"))
    of = lambda name: t.read(f"market_daily_page_{name}").join(markets, "page_market_id")
    codes = F.array_position(F.array(*[F.lit(x[1]) for x in feeds.TICKERS]), F.col("index_code")) - 1
    hour = F.hour(F.from_utc_timestamp("published_at", V.BUSINESS_OFFSET))
    out = row(job, "job", one, joined("status", "raw_news_count", "processed_news_count", "cluster_count"))
    parts = (
        row(page, "page", one, joined(F.concat(F.lit("V"), "version_no"), "status", "global_headline", "raw_news_count", "processed_news_count", "cluster_count")),
        row(t.read("market_daily_page_market"), "market", F.col("display_order"), joined("market_label", "summary_title", "summary_body", "cluster_count")),
        row(of("market_cluster"), "cluster", F.col("m"), joined("title", "summary", "article_count")),
        row(of("article_link"), "link", F.col("m") * 1_000_000 + F.col("display_order"), joined("title", hour)),
        row(of("market_index"), "quote", codes, joined("close_price", "change_value")),
        row(t.read("batch_job_event"), "event", F.col("id"), joined("step_code", "level", "message")),
    )
    for p in parts:
        out = out.unionByName(p)
    return out
