"""Joins of the briefing's tables, and their general shapes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefloom.operators.lookup import equal_to
from briefloom.schemas import market_order


def clusters_with_representative(clusters: DataFrame, articles: DataFrame, day=None, market_type: str | None = None) -> DataFrame:
    """Clusters and their representative article, kept where it is missing; by market and rank."""
    p = articles.select(
        F.col("id").alias("representative_article_id"),
        F.col("canonical_title").alias("representative_title"),
        F.col("publisher_name").alias("representative_publisher_name"),
        F.col("published_at").alias("representative_published_at"),
        F.col("origin_link").alias("representative_origin_link"),
        F.col("naver_link").alias("representative_naver_link"),
    )
    own = clusters.where(equal_to(business_date=day, market_type=market_type))
    return own.join(p, "representative_article_id", "left").orderBy(market_order(), "cluster_rank")


def cluster_article_links(clusters: DataFrame, members: DataFrame, articles: DataFrame, day=None, market_type: str | None = None) -> DataFrame:
    """Articles of all clusters; undated ones come first among equal ranks."""
    c = clusters.where(equal_to(business_date=day, market_type=market_type)).select(
        F.col("id").alias("cluster_id"), "cluster_uid", F.col("title").alias("cluster_title"), "market_type", "cluster_rank"
    )
    p = articles.select(
        F.col("id").alias("processed_article_id"), F.col("canonical_title").alias("title"), "publisher_name", "published_at", "origin_link", "naver_link"
    )
    joined = members.select("cluster_id", "processed_article_id", "article_rank").join(c, "cluster_id").join(p, "processed_article_id")
    return joined.orderBy(market_order(), "cluster_rank", "article_rank", F.col("published_at").desc_nulls_first(), "processed_article_id")


def nested(children: DataFrame, key: str | Sequence[str], order: Sequence[str], fields: Sequence[str | Column], name: str) -> DataFrame:
    """One row a parent key: its children as an array of structs in the given order."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("__child"))))
    return children.groupBy(*([key] if isinstance(key, str) else key)).agg(F.transform(ordered, lambda x: x["__child"]).alias(name))


def nested_kinds(key: str, order: Sequence[str], kinds: dict[str, tuple[DataFrame, Sequence[str | Column]]]) -> DataFrame:
    """As :func:`nested` for several kinds of children by name, with one aggregation over all of them."""
    parts = [df.select(key, *order, F.struct(*fields).alias(name)) for name, (df, fields) in kinds.items()]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def array(name: str) -> Column:
        own = F.collect_list(F.when(F.col(name).isNotNull(), F.struct(*order, F.col(name).alias("__child"))))
        return F.transform(F.array_sort(own), lambda x: x["__child"]).alias(name)

    return rows.groupBy(key).agg(*[array(name) for name in kinds])


def with_nested(parents: DataFrame, key: str, kids: DataFrame, *names: str) -> DataFrame:
    """Parents with the arrays of :func:`nested`, empty where there are none."""
    kind = dict(kids.dtypes)
    return parents.join(kids, key, "left").withColumns({n: F.coalesce(n, F.array().cast(kind[n])) for n in names})


def last_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key; one aggregation, no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")).select(*keys, "__last.*")


def null_safe_lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Left join in which null keys equal null keys; ``columns`` are new name: right column."""
    r = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(v).alias(k) for k, v in columns.items()])
    on = [left[k].eqNullSafe(r[f"__{k}"]) for k in keys]
    return left.join(r, on, "left").drop(*[f"__{k}" for k in keys])


def not_in(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_anti")


def only_in(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_semi")


def as_of(quotes: DataFrame, keys: Sequence[str], at: Column, on: str, carry: Sequence[str]) -> DataFrame:
    """The last row of each key not after ``at``, and ``previous_<column>`` of the one before it."""
    order = Window.partitionBy(*keys).orderBy(F.col(on).desc())
    own = quotes.where(F.col(on) <= at).select(
        "*", F.row_number().over(order).alias("__n"), *[F.lead(c).over(order).alias(f"previous_{c}") for c in carry]
    )
    return own.where("__n = 1").drop("__n")
