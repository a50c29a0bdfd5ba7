"""Point lookups, filters and ordered scans."""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.schemas import market_order

ACTIVE = ("PENDING", "RUNNING")


def by_value(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose ``column`` equals ``value`` (a key, a hash)."""
    return df.where(F.col(column) == F.lit(value))


def by_uid(df: DataFrame, value: str, column: str = "cluster_uid") -> DataFrame:
    """Rows of a UUID; a malformed one raises ValueError."""
    return by_value(df, column, str(uuid.UUID(value)))


def active_jobs(jobs: DataFrame, day: dt.date) -> DataFrame:
    return jobs.where((F.col("business_date") == F.lit(day)) & F.col("status").isin(*ACTIVE))


def pages_of(pages: DataFrame, day: dt.date) -> DataFrame:
    return pages.where(F.col("business_date") == F.lit(day))


def any_row(df: DataFrame, name: str) -> DataFrame:
    """One row: whether there is one; no more than one is read."""
    return df.limit(1).agg((F.count(F.lit(1)) > 0).alias(name))


def has_active_job(jobs: DataFrame, day: dt.date) -> bool:
    return not active_jobs(jobs, day).limit(1).isEmpty()


def has_page(pages: DataFrame, day: dt.date) -> bool:
    return not pages_of(pages, day).limit(1).isEmpty()


def conjunction(*parts: Column | None) -> Column:
    """All given conditions; None means no condition."""
    return reduce(lambda a, b: a & b, [p for p in parts if p is not None], F.lit(True))


def date_status_filter(date_column: str, from_date=None, to_date=None, status: str | None = None, status_column: str = "status") -> Column:
    """Optional bounds, both inclusive, and an optional status."""
    return conjunction(
        None if from_date is None else F.col(date_column) >= F.lit(from_date),
        None if to_date is None else F.col(date_column) <= F.lit(to_date),
        None if status is None else F.col(status_column) == F.lit(status),
    )


def equal_to(**values) -> Column:
    """Optional equalities."""
    return conjunction(*[None if v is None else F.col(k) == F.lit(v) for k, v in values.items()])


def list_keywords(keywords: DataFrame, provider_name=None, market_type=None, is_active=None) -> DataFrame:
    own = keywords.where(equal_to(provider_name=provider_name, market_type=market_type, is_active=is_active))
    return own.orderBy("provider_name", market_order(), "priority", "id")


def list_articles(articles: DataFrame, day: dt.date, market_type: str | None = None) -> DataFrame:
    """A day's raw or processed articles: market, newest first with undated last, id."""
    own = articles.where((F.col("business_date") == F.lit(day)) & equal_to(market_type=market_type))
    return own.orderBy(market_order(), F.col("published_at").desc_nulls_last(), "id")


def list_indices(indices: DataFrame, day: dt.date) -> DataFrame:
    return indices.where(F.col("business_date") == F.lit(day)).orderBy(market_order(), "index_code")


def list_cluster_ids(clusters: DataFrame, day: dt.date, market_type: str) -> DataFrame:
    own = clusters.where((F.col("business_date") == F.lit(day)) & equal_to(market_type=market_type))
    return own.orderBy("cluster_rank").select("id")


def children_of(children: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Rows whose ``key`` is among the parents' (a semi join, however many parents)."""
    return children.join(parents.select(F.col(parent_key).alias(key)), key, "left_semi")


def page_markets(markets: DataFrame, page_id: int) -> DataFrame:
    return by_value(markets, "page_id", page_id).orderBy("display_order")


def in_request_order(df: DataFrame, ids: list[int], column: str = "id", place: str | None = None) -> DataFrame:
    """Rows by a list of ids, in its order, if asked for with their place in it; unknown ids are left out, repeated ones repeat."""
    name = place or "__place"
    asked = df.sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids)], f"{column} long, {name} int")
    got = df.join(asked, column).orderBy(name)
    return got if place else got.drop(name)


def renamed(df: DataFrame, **names: str) -> DataFrame:
    """Columns under the names of the read interface."""
    return df.select(*[F.col(old).alias(new) for new, old in names.items()])


def cluster_members(members: DataFrame, cluster_id: int) -> DataFrame:
    return by_value(members, "cluster_id", cluster_id).orderBy("article_rank", "processed_article_id")


def job_summaries(summaries: DataFrame, job_id: int) -> DataFrame:
    return by_value(summaries, "batch_job_id", job_id).orderBy("generated_at", "id")
