"""What the briefing takes in: news items, fetched pages, price histories, model answers.

All of it arrives as tables; nothing here opens a connection to the outside.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefloom.functions import text as X
from briefloom.functions import values as V
from briefloom.functions.html import body_text
from briefloom.operators.ranking import take_while

#: Results of a page, and the last start a feed serves.
PAGE_SIZE, LAST_START = 100, 1000
#: Fixed values: (market, ticker, name, currency).
TICKERS = (
    ("US", "^GSPC", "S&P 500", "USD"),
    ("US", "^IXIC", "NASDAQ", "USD"),
    ("US", "^DJI", "Dow Jones", "USD"),
    ("KR", "^KS11", "KOSPI", "KRW"),
    ("KR", "^KQ11", "KOSDAQ", "KRW"),
)
DAYS_BACK = 7
NOT_AN_OBJECT = "The answer is not a JSON object."


def served(items: DataFrame) -> DataFrame:
    """Items of ``(keyword_id, place, item json)`` that paging reaches.

    Pages start at 1, 101, ... up to ``LAST_START``; a page that isn't full, or is missing, ends the scan.
    """
    own = items.where(F.col("place") < (LAST_START - 1) // PAGE_SIZE * PAGE_SIZE + PAGE_SIZE).withColumn("__page", F.floor(F.col("place") / PAGE_SIZE))
    # ten rows a keyword
    pages = own.groupBy("keyword_id", "__page").agg(F.count("*").alias("__items"))
    w = Window.partitionBy("keyword_id").orderBy("__page")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.withColumn("__full", F.coalesce(F.min("__items").over(before) >= PAGE_SIZE, F.lit(True))).withColumn("__n", F.row_number().over(w) - 1)
    reached = pages.where(F.col("__full") & (F.col("__n") == F.col("__page"))).select("keyword_id", "__page")
    return own.join(reached, ["keyword_id", "__page"], "left_semi").drop("__page")


def articles_of_day(items: DataFrame, keywords: DataFrame, day: dt.date) -> DataFrame:
    """Raw articles of a business day from the feed's newest-first items.

    Items without a readable date are passed over; the first older one ends a keyword's scan.
    """
    field = lambda n: X.json_field(F.col("item"), n)
    own = served(items).withColumn("published_at", V.parse_pub_date(field("pubDate"))).where("published_at is not null")
    own = own.withColumn("day", V.business_date(F.col("published_at")))
    kept = take_while(own, ["keyword_id"], "place", F.col("day") < F.lit(day)).where(F.col("day") == F.lit(day))
    k = keywords.select(F.col("id").alias("keyword_id"), "provider_name", "market_type", F.col("keyword").alias("search_keyword"))
    return kept.join(F.broadcast(k) if keywords.limit(10_001).count() <= 10_000 else k, "keyword_id").select(
        "keyword_id",
        "place",
        "provider_name",
        X.provider_key(field("originallink"), field("link"), field("title"), V.pub_iso(field("pubDate"))).alias("provider_article_key"),
        "market_type",
        F.lit(day).alias("business_date"),
        "search_keyword",
        X.strip_html(field("title")).alias("title"),
        F.lit(None).cast("string").alias("publisher_name"),
        "published_at",
        field("originallink").alias("origin_link"),
        field("link").alias("naver_link"),
        F.col("item").alias("payload_json"),
    )


def article_content(articles: DataFrame, pages: DataFrame, summary: Column, own: Sequence[str] = ()) -> DataFrame:
    """Body text from fetched ``pages(url, html)``: the origin link's, else the portal link's, else the summary.

    A url stands once in ``pages``, or once an article where each has its own fetches: ``own`` are
    columns of both tables that name the article, as one url may give other content at another time.
    """
    bodies = pages.select(*own, "url", body_text("html").alias("body")).where("body is not null")
    a = bodies.select(*own, F.col("url").alias("origin_link"), F.col("body").alias("__a"))
    b = bodies.select(*own, F.col("url").alias("naver_link"), F.col("body").alias("__b"))
    joined = articles.withColumn("source_summary", summary).join(a, [*own, "origin_link"], "left").join(b, [*own, "naver_link"], "left")
    link = X.first_link(F.col("origin_link"), F.col("naver_link"))
    fetched = F.when(F.col("__a").isNotNull(), F.col("origin_link")).when(F.col("__b").isNotNull(), F.col("naver_link")).otherwise(link)
    body = F.coalesce("__a", "__b", "source_summary")
    return joined.select(
        *articles.columns,
        "source_summary",
        body.alias("body_text"),
        X.body_excerpt(body).alias("article_body_excerpt"),
        fetched.alias("fetched_url"),
        X.link_domain(fetched).alias("source_domain"),
        (F.col("__a").isNull() & F.col("__b").isNull()).alias("content_fallback_used"),
    )


def history_window(history: DataFrame, day: dt.date) -> DataFrame:
    """Price rows from a week before the day up to it."""
    return history.where((F.col("date") >= F.lit(day - dt.timedelta(days=DAYS_BACK))) & (F.col("date") < F.lit(day + dt.timedelta(days=1))))


def model_answers(raw: DataFrame, schema: str, keys: list[str]) -> DataFrame:
    """By key the parsed ``answer`` as a struct ``a``, null where fallbacks apply, and then ``error``, why.

    ``raw`` may tell in a column ``error`` of its own that a call failed.
    """
    told = F.col("error").cast("string") if "error" in raw.columns else F.lit(None).cast("string")
    a = F.when(F.nullif(told, F.lit("")).isNull(), X.model_answer(F.col("answer"), schema))
    return raw.select(*keys, a.alias("a"), F.when(a.isNull(), F.coalesce(F.nullif(told, F.lit("")), F.lit(NOT_AN_OBJECT))).alias("error"))
