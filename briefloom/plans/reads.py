"""What the read interface serves, each as one lazy DataFrame of nested rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.functions import values as V
from briefloom.operators import aggregates as A
from briefloom.operators import joins as J
from briefloom.operators import lookup as L
from briefloom.operators import ranking as R


class NotFound(Exception):
    """Nothing to serve; ``code`` says what is missing."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def _fields(**names: str | Column) -> list[Column]:
    return [F.expr(f"`{v}` AS `{k}`".replace(".", "`.`")) if isinstance(v, str) else v.alias(k) for k, v in names.items()]


def daily_page(header: DataFrame, markets: DataFrame, indices: DataFrame, clusters: DataFrame, links: DataFrame) -> DataFrame:
    """Pages with their markets, and these with index cards, cluster cards and article links, all in display order."""
    card = _fields(
        indexCode="index_code", indexName="index_name", closePrice="close_price", changeValue="change_value", changePercent="change_percent",
        highPrice="high_price", lowPrice="low_price",
    )
    representative = F.struct(*_fields(
        title="representative_title", publisherName="representative_publisher_name", publishedAt=V.iso(F.col("representative_published_at")),
        originLink="representative_origin_link", naverLink="representative_naver_link",
    ))
    cluster = _fields(
        clusterId="cluster_uid", title="title", summary="summary", articleCount="article_count",
        tags=F.coalesce("tags_json", F.array().cast("array<string>")), representativeArticle=representative,
    )
    link = _fields(
        processedArticleId="processed_article_id", clusterId="cluster_uid", clusterTitle="cluster_title", title="title", publisherName="publisher_name",
        publishedAt=V.iso(F.col("published_at")), originLink="origin_link", naverLink="naver_link",
    )
    kids = J.nested_kinds("page_market_id", ["display_order"], {"indices": (indices, card), "topClusters": (clusters, cluster), "articleLinks": (links, link)})
    m = L.children_of(markets, header, "page_id").withColumnRenamed("id", "page_market_id")
    m = J.with_nested(m, "page_market_id", kids, "indices", "topClusters", "articleLinks")
    empty = F.array().cast("array<string>")
    sections = J.nested(
        m, "page_id", ["display_order"],
        _fields(
            marketType="market_type", marketLabel="market_label", summaryTitle="summary_title", summaryBody="summary_body",
            analysis=F.struct(*_fields(background=F.coalesce("analysis_background_json", empty), keyThemes=F.coalesce("analysis_key_themes_json", empty), outlook="analysis_outlook")),
            indices="indices", topClusters="topClusters", articleLinks="articleLinks",
            metadata=F.struct(*_fields(rawNewsCount="raw_news_count", processedNewsCount="processed_news_count", clusterCount="cluster_count",
                                       lastUpdatedAt=V.iso(F.col("last_updated_at")), partialMessage="partial_message")),
        ), "markets",
    )
    h = J.with_nested(header.withColumnRenamed("id", "page_id"), "page_id", sections, "markets")
    return h.select(*_fields(
        pageId="page_id", businessDate="business_date", versionNo="version_no", pageTitle="page_title", status="status", globalHeadline="global_headline",
        generatedAt=V.iso(F.col("generated_at")), partialMessage="partial_message", markets="markets",
        metadata=F.struct(*_fields(rawNewsCount="raw_news_count", processedNewsCount="processed_news_count", clusterCount="cluster_count",
                                   lastUpdatedAt=V.iso(F.col("last_updated_at")))),
    ))


def _page(t, header: DataFrame, code: str) -> DataFrame:
    """One page.  Its id, its day and its markets' ids (one for each market) are read first, so that every scan is of their partitions and filtered by them."""
    found = header.select("id", "business_date").head(1)
    if not found:
        raise NotFound(code)
    page = L.by_value(L.by_value(t.read("market_daily_page", [found[0].business_date]), "business_date", found[0].business_date), "id", found[0].id)
    markets = L.by_value(t.read("market_daily_page_market", [found[0].id]), "page_id", found[0].id)
    ids = [r.id for r in markets.select("id").collect()]
    return daily_page(page, markets, *[t.read(f"market_daily_page_{n}", ids).where(F.col("page_market_id").isin(ids)) for n in ("market_index", "market_cluster", "article_link")])


def latest_page(t) -> DataFrame:
    return _page(t, R.latest_page(t.read("market_daily_page", t.days("market_daily_page")[-1:] or None)), "LATEST_PAGE_NOT_FOUND")


def page_by_date(t, day: dt.date, version_no: int | None = None) -> DataFrame:
    return _page(t, R.page_of_day(t.read("market_daily_page", [day]), day, version_no), "PAGE_NOT_FOUND")


def page_by_id(t, page_id: int) -> DataFrame:
    return _page(t, L.by_value(t.read("market_daily_page"), "id", page_id), "PAGE_NOT_FOUND")


def archive(t, from_date=None, to_date=None, status: str | None = None, page: int = 1, size: int = 30) -> tuple[DataFrame, DataFrame]:
    """(a page of the latest version of each day among the pages that pass, number of such days)."""
    if page < 1 or not 1 <= size <= 100:
        raise ValueError("page from 1, size 1 to 100")
    pages, passing = t.read("market_daily_page"), L.date_status_filter("business_date", from_date, to_date, status)
    items = L.renamed(
        R.paged(R.latest_versions(pages, passing), page, size), pageId="id", businessDate="business_date", versionNo="version_no", pageTitle="page_title",
        status="status", globalHeadline="global_headline", generatedAt="generated_at", partialMessage="partial_message",
    )
    return items, A.distinct_days(pages, passing)


def cluster_detail(t, uid: str) -> DataFrame:
    """A cluster with its representative and its articles in rank order."""
    cluster = L.by_uid(t.read("news_cluster"), uid)
    found = cluster.select("id", "business_date").head(1)
    if not found:
        raise NotFound("CLUSTER_NOT_FOUND")
    articles, members = t.read("news_article_processed", [found[0].business_date]), t.read("news_cluster_article", [found[0].id])
    shown = _fields(
        processedArticleId="id", title="canonical_title", publisherName="publisher_name", publishedAt=V.iso(F.col("published_at")),
        originLink="origin_link", naverLink="naver_link",
    )
    head = articles.select(F.col("id").alias("representative_article_id"), F.struct(*shown).alias("representativeArticle"))
    joined = cluster.join(head, "representative_article_id")
    if joined.isEmpty():
        raise NotFound("REPRESENTATIVE_ARTICLE_NOT_FOUND")
    own = L.children_of(members, cluster, "cluster_id").join(articles.withColumnRenamed("id", "processed_article_id"), "processed_article_id")
    listed = J.nested(own.withColumn("id", F.col("processed_article_id")), "cluster_id", ["article_rank", "processed_article_id"], shown, "articles")
    out = J.with_nested(joined.withColumnRenamed("id", "cluster_id"), "cluster_id", listed, "articles")
    return out.select(*_fields(
        clusterId="cluster_uid", businessDate="business_date", marketType="market_type", marketLabel=V.cluster_label(F.col("market_type")), title="title",
        tags="tags_json", summary=F.struct(*_fields(short="summary_short", long="summary_long", analysis="analysis_paragraphs_json")),
        representativeArticle="representativeArticle", articles="articles", lastUpdatedAt=V.iso(F.col("updated_at")), articleCount="article_count",
    ))


JOB_FIELDS = {
    "jobId": "job_id", "jobName": "job_name", "businessDate": "business_date", "status": "status", "startedAt": "started_at", "endedAt": "ended_at",
    "durationSeconds": "duration_seconds", "marketScope": "market_scope", "rawNewsCount": "raw_news_count", "processedNewsCount": "processed_news_count",
    "clusterCount": "cluster_count", "pageId": "page_id", "pageVersionNo": "page_version_no", "partialMessage": "partial_message",
}


def job_list(t, from_date=None, to_date=None, status: str | None = None, page: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """(a page of jobs, newest first; one row with the total and the status summary)."""
    jobs, passing = t.read("batch_job"), L.date_status_filter("business_date", from_date, to_date, status)
    return L.renamed(R.job_list(jobs, passing, page, size), **JOB_FIELDS), A.status_summary(jobs.where(passing))


def job_detail(t, job_id: int) -> DataFrame:
    job = L.by_value(t.read("batch_job"), "job_id", job_id)
    if job.isEmpty():
        raise NotFound("JOB_NOT_FOUND")
    more = {"forceRun": "force_run", "rebuildPageOnly": "rebuild_page_only", "errorCode": "error_code", "errorMessage": "error_message", "logSummary": "log_summary"}
    return L.renamed(job, **JOB_FIELDS, **more)
