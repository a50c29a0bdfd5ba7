"""The daily batch: eight steps over :class:`~briefloom.sources.tables.Tables`.

A step reads the day's partitions, writes what it makes and adds to the job's run; the driver holds
only counters, which the writes themselves report, and notes.  What a step writes is published
as one version of all tables when it ends, or not at all.  Inputs from outside (feed items,
fetched pages, price history, model answers) come as DataFrames; where model answers are
missing the fallbacks apply.
"""

from __future__ import annotations

import datetime as dt
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from briefloom.functions import text as X
from briefloom.functions import values as V
from briefloom.operators import aggregates as A
from briefloom.operators import grouping as G
from briefloom.operators import joins as J
from briefloom.operators import lookup as L
from briefloom.operators import ranking as R
from briefloom.schemas import market_order
from briefloom.sources import feeds, tables as S
from briefloom.sources.store import Tables

#: Texts of fallbacks and reasons.
HEADLINE = "시장 주요 이슈를 종합한 글로벌 일간 요약"
MARKET_TITLE = " 시장 핵심 이슈 요약"
NO_CLUSTERS = "요약 생성에 필요한 클러스터가 없습니다."
NO_SNAPSHOT = "스냅샷 생성에 필요한 클러스터 데이터가 없습니다."
NO_INDICES = "No market index data was collected."
NO_ANSWER = "The model gave no answer."
#: Fields of a model's answers.
CLUSTER_FIELDS = "title string, summary_short string, summary_long string, tags array<string>, analysis_paragraphs array<string>, representative_article_index int"
HEADLINE_FIELDS = CARD_FIELDS = "title string, body string"
MARKET_FIELDS = "title string, body string, background array<string>, key_themes array<string>, outlook string"
DETAIL_FIELDS = "title string, body string, paragraphs array<string>"
JOB_NAME, SCOPE = "market_daily_batch", "GLOBAL"
REASON, ANSWERED = '{"reason":"llm_fallback"}', '{"reason":"llm"}'


class JobRejected(Exception):
    """A job that must not start; ``code`` says why."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


@dataclass
class Run:
    """One job as it goes: counts by name, notes in the order they were made, and how it ended."""

    job_id: int
    day: dt.date
    rebuild_page_only: bool = False
    counts: Counter = field(default_factory=Counter)
    notes: list[tuple[str, str]] = field(default_factory=list)
    events: list[tuple] = field(default_factory=list)
    page: tuple[int, int] | None = None
    failure: tuple[str, str] | None = None

    def note(self, kind: str, text: str) -> None:
        """``kind`` is one of reason and warning, which make the job a partial one, and log."""
        self.notes.append((kind, text))

    def told(self, kind: str) -> list[str]:
        return [text for k, text in self.notes if k == kind]

    @property
    def partial_message(self) -> str | None:
        return "; ".join(self.told("reason")[:3]) or None

    @property
    def status(self) -> str:
        if self.failure or self.page is None:
            return "FAILED"
        return "PARTIAL" if self.told("reason") or self.told("warning") or self.counts["fallbacks"] else "SUCCESS"


@dataclass
class Inputs:
    """What a run takes in; None where there is nothing.

    Answers are a model's raw texts in a column ``answer`` (and, where a call failed, ``error``): one row
    for the headline, and by ``market_type``, or ``market_type`` and the cluster's rank in
    ``group_no``, for the others.  A table says that a model is set up; where a row is missing or
    unreadable the fallbacks apply.
    """

    items: DataFrame | None = None
    fetched_pages: DataFrame | None = None
    history: DataFrame | None = None
    grouping: bool = False
    cluster_answers: DataFrame | None = None
    headline_answers: DataFrame | None = None
    market_answers: DataFrame | None = None
    card_answers: DataFrame | None = None
    detail_answers: DataFrame | None = None
    model_name: str = "model"


def _event(c: Run, step: str, level: str, message: str, context_json: str | None = None) -> None:
    """An event of the job; put down with those before it by :func:`_tell`."""
    c.events.append((step, level, message, context_json, dt.datetime.now(dt.timezone.utc)))


def _tell(t: Tables, c: Run) -> None:
    """Append the events that wait, in their order, in one write."""
    top = t.top("batch_job_event")
    rows = [(top + k, c.job_id, *e) for k, e in enumerate(c.events, 1)]
    c.events.clear()
    if rows:
        t.append("batch_job_event", t.spark.createDataFrame(rows, "id long, batch_job_id long, step_code string, level string, message string, context_json string, created_at timestamp"))


def status_policy(df: DataFrame) -> DataFrame:
    """The same policy over rows with the columns of a context."""
    filled = lambda c: F.nullif(F.col(c), F.lit("")).isNotNull()
    partial = filled("partial_message") | (F.col("partial_reasons") > 0) | (F.col("warnings") > 0) | (F.col("fallback_count") > 0)
    failed = filled("error_code") | filled("error_message") | F.col("page_id").isNull()
    return df.withColumn("status", F.when(failed, "FAILED").when(partial, "PARTIAL").otherwise("SUCCESS"))


def start_job(t: Tables, day: dt.date, user: str | None = None, force: bool = False, rebuild_page_only: bool = False) -> Run:
    """A RUNNING job of the day; rejected if one is active, or a page exists and ``force`` isn't given."""
    jobs = t.read("batch_job", [day])
    if L.has_active_job(jobs, day):
        raise JobRejected("BATCH_ALREADY_RUNNING")
    if not force and L.has_page(t.read("market_daily_page", [day]), day):
        raise JobRejected("PAGE_ALREADY_EXISTS")
    job_id = t.top("batch_job") + 1
    now = dt.datetime.now(dt.timezone.utc)
    row = {
        "job_id": job_id, "job_name": JOB_NAME, "business_date": day, "status": "RUNNING", "trigger_type": "MANUAL", "triggered_by_user_id": user,
        "force_run": force, "rebuild_page_only": rebuild_page_only, "started_at": now, "market_scope": SCOPE, "raw_news_count": 0,
        "processed_news_count": 0, "cluster_count": 0, "created_at": now, "updated_at": now,
    }
    schema = jobs.schema
    c = Run(job_id, day, rebuild_page_only)
    with t.transaction():
        t.append("batch_job", t.spark.createDataFrame([tuple(row.get(f.name) for f in schema)], schema))
        _event(c, "CREATE_JOB", "INFO", "Batch job created.")
        _tell(t, c)
    return c


def create_job_step(t: Tables, c: Run, inputs: Inputs) -> None:
    c.note("log", f"Job {c.job_id} created.")


def collect_news_step(t: Tables, c: Run, inputs: Inputs) -> None:
    keywords = L.list_keywords(t.read("news_search_keyword"), is_active=True)
    if keywords.isEmpty():
        _event(c, "COLLECT_NEWS", "WARN", "No active keywords.")
        return
    if inputs.items is None:
        raise ValueError("active keywords but no feed items")
    now = F.current_timestamp()
    found = feeds.articles_of_day(inputs.items, keywords, c.day)
    keys = ["provider_name", "provider_article_key"]
    first = S.staged(R.first_per_key(found, keys, [F.col("keyword_id"), F.col("place")]))
    new = t.unknown("news_article_raw", first)
    rows = S.with_ids(new.withColumn("collected_at", now).withColumn("created_at", now), t.top("news_article_raw"), ["keyword_id", "place"]).drop("keyword_id", "place")
    added = t.append("news_article_raw", rows).rows
    c.counts["raw_news"] += added
    c.note("log", f"Collected {added} new raw articles.")


def dedupe_articles_step(t: Tables, c: Run, inputs: Inputs) -> None:
    if c.rebuild_page_only:
        c.note("log", "Deduplication skipped: page rebuild.")
        return
    raw = L.list_articles(t.read("news_article_raw", [c.day]), c.day)
    if raw.isEmpty():
        _event(c, "DEDUPE_ARTICLES", "WARN", "No raw articles.")
        c.note("log", "No raw articles to deduplicate.")
        return
    link = X.first_link(F.col("origin_link"), F.col("naver_link"))
    hashed = raw.withColumn("dedupe_hash", X.dedupe_hash(F.col("title"), link)).withColumn("__order", market_order())
    order = [F.col("__order"), F.col("published_at").desc_nulls_last(), F.col("id")]
    hashed = S.staged(hashed)
    had = S.staged(t.known_ids("news_article_processed", hashed))
    first = J.not_in(R.first_per_key(hashed, ["dedupe_hash"], order), had, ["dedupe_hash"])
    pages = inputs.fetched_pages if inputs.fetched_pages is not None else t.spark.createDataFrame([], "url string, html string")
    content = feeds.article_content(first, pages, X.excerpt(X.json_field(F.col("payload_json"), "description")))
    now = F.current_timestamp()
    made = content.select(
        "business_date", "market_type", "dedupe_hash", X.normalize_title(F.col("title")).alias("canonical_title"), "publisher_name", "published_at",
        X.canonicalize_link(link).alias("origin_link"), "naver_link", "source_summary", "article_body_excerpt",
        X.json_row(
            F.col("provider_name").alias("providerName"), F.col("provider_article_key").alias("providerArticleKey"), F.col("payload_json").alias("payload"),
            F.col("dedupe_hash").alias("dedupeHash"), F.col("body_text").alias("bodyText"), F.col("source_domain").alias("sourceDomain"),
            F.col("fetched_url").alias("fetchedUrl"), F.col("content_fallback_used").alias("contentFallbackUsed"),
        ).alias("content_json"),
        now.alias("created_at"), now.alias("updated_at"), F.col("id").alias("__raw"),
    )
    t.append("news_article_processed", S.with_ids(made, t.top("news_article_processed"), ["__raw"]).drop("__raw"))
    added = t.read("news_article_processed", [c.day]).select("dedupe_hash", "id")
    ids = J.not_in(added, had, ["dedupe_hash"]).unionByName(had).select("dedupe_hash", F.col("id").alias("processed_article_id"))
    links = hashed.select(F.col("id").alias("raw_article_id"), "dedupe_hash").join(ids, "dedupe_hash")
    own = t.parents("news_article_raw_processed_map", ids.select("processed_article_id"))
    known = t.read("news_article_raw_processed_map", own)
    t.append("news_article_raw_processed_map", J.not_in(links, known, ["raw_article_id", "processed_article_id"]).withColumn("created_at", now))
    c.counts["processed_news"] += links.agg(F.countDistinct("processed_article_id")).first()[0]
    c.note("log", f"Deduplicated into {c.counts['processed_news']} articles.")


def build_clusters_step(t: Tables, c: Run, inputs: Inputs) -> None:
    if c.rebuild_page_only:
        c.note("log", "Clustering skipped: page rebuild.")
        return
    articles = t.read("news_article_processed", [c.day]).where(F.col("business_date") == F.lit(c.day))
    if articles.isEmpty():
        _event(c, "BUILD_CLUSTERS", "WARN", "No processed articles.")
        c.note("log", "No processed articles to cluster.")
        return
    keys = ["market_type", "group_no"]
    if inputs.grouping:
        ordered = articles.select(
            "market_type", F.col("published_at").isNull().alias("a"), (-F.unix_micros("published_at")).alias("b"), "id", X.tokens(F.col("canonical_title")).alias("words")
        )
        groups = G.greedy_groups(ordered, ["market_type"], ["a", "b"], "words", "id")
    else:
        groups = G.one_group(articles, ["market_type"], "id")
    described = G.described(articles.drop("market_type").join(groups, "id"), keys)
    if inputs.cluster_answers is not None:
        described = G.answered(described, feeds.model_answers(inputs.cluster_answers, CLUSTER_FIELDS, keys), keys)
    else:
        described = described.withColumns({"fallback_used": F.lit(True), "error": F.lit(None).cast("string")})
    day, now = [c.day], F.current_timestamp()
    clusters = t.read("news_cluster", day)
    rows = described.withColumn("business_date", F.lit(c.day)).withColumn("__order", market_order())
    # a rebuild makes new clusters: their uids are new too
    digest = F.md5(F.concat_ws("|", F.lit(c.job_id), F.col("business_date").cast("string"), "market_type", "group_no"))
    uid = F.regexp_replace(digest, r"^(.{8})(.{4}).(.{3})(.{4})(.{12})$", "$1-$2-4$3-$4-$5")
    rows = S.with_ids(rows, t.top("news_cluster"), ["__order", "group_no"]).select(
        "id", uid.alias("cluster_uid"), "business_date", "market_type", F.col("group_no").alias("cluster_rank"), "title", "summary_short", "summary_long",
        "analysis_paragraphs_json", "tags_json", "representative_article_id", "article_count", now.alias("created_at"), now.alias("updated_at"), "article_ids",
        (F.col("fallback_used") & (F.col("error").isNotNull() | F.lit(inputs.cluster_answers is not None))).alias("__fell_back"), "error",
    )
    markets = articles.select("market_type").distinct()
    old = J.only_in(clusters.where(F.col("business_date") == F.lit(c.day)), markets, ["market_type"]).select("id")
    rows = S.staged(rows)
    if not old.isEmpty():  # all that hangs on the day's old clusters lies in partitions of the day, or of their ids
        own = t.parents("news_cluster_article", old)
        t.replace("news_cluster_article", S.delete(t.read("news_cluster_article", own), old, "cluster_id"), own)
        t.replace("ai_summary", S.delete(t.read("ai_summary", day), old, "cluster_id"), day)
        pages = t.read("market_daily_page", day).select("id")
        markets_of = L.children_of(t.read("market_daily_page_market", t.parents("market_daily_page_market", pages)), pages, "page_id").select("id")
        for name in ("market_daily_page_market_cluster", "market_daily_page_article_link"):
            own = t.parents(name, markets_of)
            t.replace(name, S.set_null(t.read(name, own), old, "cluster_id"), own)
    t.append("news_cluster_article", S.members_of(rows.select(F.col("id").alias("cluster_id"), "article_ids")).withColumn("created_at", now))
    t.replace("news_cluster", S.delete(clusters, old).unionByName(rows.select(*clusters.columns)), day)
    c.counts["clusters"] += rows.count()
    _cluster_events(t, c, rows)
    c.note("log", f"Created {c.counts['clusters']} clusters.")


def _cluster_events(t: Tables, c: Run, clusters: DataFrame) -> None:
    """An INFO event for each new cluster, before it a WARN where the model's answer was missing or unreadable."""
    error = F.coalesce("error", F.lit(NO_ANSWER))
    fell_back = X.json_row(
        F.col("market_type").alias("marketType"), F.col("cluster_rank").alias("clusterRank"), F.col("representative_article_id").alias("representativeArticleId"),
        F.lit("llm_fallback").alias("fallbackReason"), F.struct(error.alias("message")).alias("error"),
    )
    made = X.json_row(
        F.col("market_type").alias("marketType"), F.col("id").alias("clusterId"), F.col("cluster_rank").alias("clusterRank"), F.col("article_count").alias("articleCount")
    )
    event = lambda place, level, message, context: F.struct(
        F.lit(place).alias("place"), F.lit(level).alias("level"), F.lit(message).alias("message"), context.alias("context_json")
    )
    both = F.array(
        F.when(F.col("__fell_back"), event(0, "WARN", "Cluster enrichment used the fallback.", fell_back)), event(1, "INFO", "Cluster created.", made)
    )
    rows = clusters.select(market_order().alias("__market"), "cluster_rank", F.explode(F.filter(both, lambda e: e.isNotNull())).alias("e"))
    rows = rows.select("__market", "cluster_rank", "e.*").withColumns(
        {"batch_job_id": F.lit(c.job_id), "step_code": F.lit("BUILD_CLUSTERS"), "created_at": F.current_timestamp()}
    )
    _tell(t, c)
    t.append("batch_job_event", S.with_ids(rows, t.top("batch_job_event"), ["__market", "cluster_rank", "place"]))


def index_quotes(history: DataFrame, tickers: DataFrame, day: dt.date) -> DataFrame:
    """A quote per ticker: the last row up to the day, and its change on the one before (else on its open)."""
    got = J.as_of(feeds.history_window(history, day), ["ticker"], F.lit(day), "date", ["close"])
    previous = F.coalesce("previous_close", "open")
    diff, percent = V.change(F.col("close"), previous)
    return (
        got.where(F.col("close").isNotNull() & previous.isNotNull())
        .join(tickers, "ticker")
        .select(
            "market_type", F.col("ticker").alias("index_code"), "index_name", "currency_code", F.col("date").alias("source_date"),
            V.quantized(F.col("close")).alias("close_price"), diff.alias("change_value"), percent.cast("decimal(10,4)").alias("change_percent"),
            V.quantized(F.col("high")).alias("high_price"), V.quantized(F.col("low")).alias("low_price"),
        )
    )


def collect_indices_step(t: Tables, c: Run, inputs: Inputs) -> None:
    tickers = t.spark.createDataFrame(list(feeds.TICKERS), "market_type string, ticker string, index_name string, currency_code string")
    quotes = None if inputs.history is None else S.staged(index_quotes(inputs.history, tickers, c.day))  # a row a ticker
    if quotes is None or quotes.isEmpty():
        c.note("reason", NO_INDICES)
        return
    late = quotes.where(F.col("source_date") != F.lit(c.day)).select("index_code").orderBy("index_code").collect()
    c.notes += [("warning", f"{r.index_code} is of an earlier day.") for r in late]
    now, keys, table = F.current_timestamp(), ["business_date", "market_type", "index_code"], t.read("market_index_daily", [c.day])
    rows = quotes.drop("source_date").withColumns({"business_date": F.lit(c.day), "provider_name": F.lit("HISTORY"), "collected_at": now, "created_at": now})
    t.replace("market_index_daily", S.upsert(table, S.with_ids(rows, t.top("market_index_daily"), keys).select(*table.columns), keys), [c.day])
    c.note("log", "Collected market indices.")


def _with_answers(rows: DataFrame, raw: DataFrame | None, fields: str, keys: list[str], model_name: str, metadata=None, body_falls_back: bool = True) -> DataFrame:
    """Fallback rows with a model's answers over them, field by field; what the answer leaves empty stays.

    ``metadata`` gives the metadata of an answered row from its struct ``a``.
    """
    none = F.lit(None).cast("string")
    if raw is None:
        return rows.withColumns({"model_name": none, "status": F.lit("FALLBACK"), "fallback_used": F.lit(True), "error_message": none})
    answers = feeds.model_answers(raw, fields, keys)
    got = rows.join(answers, keys, "left") if keys else rows.join(F.broadcast(answers.limit(1)), F.lit(True), "left")
    ok, a, filled = F.col("a").isNotNull(), F.col("a"), lambda c: F.nullif(c, F.lit(""))
    error = F.coalesce("error", F.lit(NO_ANSWER))
    told = F.concat(F.regexp_replace("metadata_json", r"\}$", ","), F.substring(X.json_row(F.struct(error.alias("message")).alias("error")), 2, 2**31 - 1))
    paragraphs = F.when(F.size(a["paragraphs"]) > 0, a["paragraphs"]).otherwise(F.col("paragraphs_json")) if "paragraphs" in fields else F.col("paragraphs_json")
    return got.withColumns(
        {
            "title": F.when(ok, F.coalesce(filled(a["title"]), "title")).otherwise(F.col("title")),
            "body": F.when(ok, F.coalesce(filled(a["body"]), F.col("body")) if body_falls_back else a["body"]).otherwise(F.col("body")),
            "paragraphs_json": F.when(ok, paragraphs).otherwise(F.col("paragraphs_json")),
            "metadata_json": F.when(ok, F.lit(ANSWERED) if metadata is None else metadata(a)).otherwise(told),
            "model_name": F.when(ok, F.lit(model_name)),
            "status": F.when(ok, "SUCCESS").otherwise("FALLBACK"),
            "fallback_used": ~ok,
            "error_message": F.when(~ok, error),
        }
    ).drop("a", "error")


def summaries_of(clusters: DataFrame, inputs: Inputs | None = None) -> DataFrame:
    """A day's summaries: one headline, one a market, two a cluster, each the model's answer or what stands in for it.

    ``clusters`` are a day's, with market and rank.  Rows come with ``place``, their order.
    """
    inputs = inputs or Inputs()
    by_rank = lambda *fields: F.array_sort(F.collect_list(F.struct(market_order().alias("m"), F.col("cluster_rank").alias("r"), *fields)))
    filled = lambda c: F.nullif(c, F.lit("")).isNotNull()
    none = lambda kind: F.lit(None).cast(kind)
    titles = F.slice(F.transform(by_rank(F.col("title").alias("t")), lambda x: x["t"]), 1, 2)
    head = clusters.agg(F.nullif(F.array_join(titles, " / "), F.lit("")).alias("t")).select(
        F.lit("GLOBAL_HEADLINE").alias("summary_type"), none("string").alias("market_type"), none("long").alias("cluster_id"),
        F.coalesce("t", F.lit(HEADLINE)).alias("title"), none("string").alias("body"), F.array().cast("array<string>").alias("paragraphs_json"),
        F.lit(REASON).alias("metadata_json"), F.array(F.lit(0)).alias("place"),
    )
    own = clusters.groupBy("market_type").agg(by_rank(F.col("summary_short").alias("s"), F.col("summary_long").alias("l"), F.col("tags_json").alias("g")).alias("c"))
    two = F.slice("c", 1, 2)
    background = F.filter(F.transform(two, lambda x: x["s"]), filled)
    themes = F.slice(F.flatten(F.transform(two, lambda x: F.coalesce(x["g"], F.array().cast("array<string>")))), 1, 5)
    market = own.select(
        F.lit("MARKET_SUMMARY").alias("summary_type"), "market_type", none("long").alias("cluster_id"),
        F.concat("market_type", F.lit(MARKET_TITLE)).alias("title"), F.col("c")[0]["s"].alias("body"), F.array().cast("array<string>").alias("paragraphs_json"),
        X.json_row(
            F.lit("llm_fallback").alias("reason"), background.alias("background"), themes.alias("keyThemes"), F.col("c")[0]["l"].alias("outlook")
        ).alias("metadata_json"),
        F.array(market_order(), F.lit(0), F.lit(0)).alias("place"), background.alias("__background"), themes.alias("__themes"), F.col("c")[0]["l"].alias("__outlook"),
    )
    some = lambda a, b: F.when(F.size(a) > 0, a).otherwise(F.col(b))
    of_market = lambda a: X.json_row(
        some(a["background"], "__background").alias("background"), some(a["key_themes"], "__themes").alias("keyThemes"),
        F.coalesce(F.nullif(a["outlook"], F.lit("")), "__outlook").alias("outlook"),
    )
    card = clusters.select(
        F.lit("CLUSTER_CARD_SUMMARY").alias("summary_type"), "market_type", F.col("id").alias("cluster_id"), "title", F.col("summary_short").alias("body"),
        F.array().cast("array<string>").alias("paragraphs_json"), F.lit(REASON).alias("metadata_json"), F.array(market_order(), F.col("cluster_rank"), F.lit(1)).alias("place"), F.col("cluster_rank").alias("group_no"),
    )
    detail = clusters.select(
        F.lit("CLUSTER_DETAIL_ANALYSIS").alias("summary_type"), "market_type", F.col("id").alias("cluster_id"), "title",
        F.coalesce(F.nullif("summary_long", F.lit("")), "summary_short").alias("body"), F.col("analysis_paragraphs_json").alias("paragraphs_json"),
        F.lit(REASON).alias("metadata_json"), F.array(market_order(), F.col("cluster_rank"), F.lit(2)).alias("place"), F.col("cluster_rank").alias("group_no"),
    )
    name, cluster = inputs.model_name, ["market_type", "group_no"]
    head = _with_answers(head, inputs.headline_answers, HEADLINE_FIELDS, [], name, body_falls_back=False)
    columns = head.columns
    parts = (
        _with_answers(market, inputs.market_answers, MARKET_FIELDS, ["market_type"], name, of_market),
        _with_answers(card, inputs.card_answers, CARD_FIELDS, cluster, name),
        _with_answers(detail, inputs.detail_answers, DETAIL_FIELDS, cluster, name),
    )
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts], head)


def summaries_step(t: Tables, c: Run, inputs: Inputs) -> None:
    clusters = t.read("news_cluster", [c.day]).where(F.col("business_date") == F.lit(c.day))
    if clusters.isEmpty() and not c.rebuild_page_only:
        c.note("reason", NO_CLUSTERS)
        return
    rows = summaries_of(clusters, inputs).withColumns(
        {"batch_job_id": F.lit(c.job_id), "business_date": F.lit(c.day), "prompt_version": F.lit("v1"), "generated_at": F.current_timestamp()}
    )
    c.counts["summaries"] = t.append("ai_summary", S.with_ids(rows, t.top("ai_summary"), ["place"]).drop("place")).rows
    c.counts["fallbacks"] += A.fallback_count(L.by_value(t.read("ai_summary", [c.day]), "batch_job_id", c.job_id)).first()[0]
    if c.counts["fallbacks"]:
        _event(c, "GENERATE_SUMMARIES", "WARN", "Summaries are fallbacks.", f'{{"fallbackCount":{c.counts["fallbacks"]}}}')
    c.note("log", f"Made {c.counts['summaries']} summaries.")


def snapshot_step(t: Tables, c: Run, inputs: Inputs) -> None:
    """Freeze the day's page under the next version: header, two markets, their cards and links."""
    day, now, own = F.lit(c.day), F.current_timestamp(), [c.day]
    articles, of_day = t.read("news_article_processed", own), t.read("news_cluster", own)
    clusters = J.clusters_with_representative(of_day, articles, c.day)
    if clusters.isEmpty() and not c.rebuild_page_only:
        c.failure = ("SNAPSHOT_SOURCE_MISSING", NO_SNAPSHOT)
        return
    links = J.cluster_article_links(of_day, t.read("news_cluster_article", t.parents("news_cluster_article", of_day.select("id"))), articles, c.day)
    indices = L.list_indices(t.read("market_index_daily", own), c.day)
    summaries = J.last_of(L.job_summaries(t.read("ai_summary", own), c.job_id), ["summary_type", "market_type", "cluster_id"], ["generated_at", "id"])
    version = A.next_number(L.by_value(t.read("market_daily_page", own), "business_date", c.day)).first()[0]
    page_id = t.top("market_daily_page") + 1
    status = "PARTIAL" if c.told("reason") or c.told("warning") else "READY"
    head = summaries.where(F.col("summary_type") == "GLOBAL_HEADLINE").agg(F.max("title").alias("global_headline"))
    counts = {"raw_news_count": F.lit(c.counts["raw_news"]), "processed_news_count": F.lit(c.counts["processed_news"])}
    t.append("market_daily_page", head.withColumns(counts | {
        "id": F.lit(page_id), "business_date": day, "version_no": F.lit(version), "page_title": V.page_title(day), "status": F.lit(status),
        "partial_message": F.lit(None).cast("string"), "cluster_count": F.lit(c.counts["clusters"]), "batch_job_id": F.lit(c.job_id),
        "metadata_json": X.json_row(F.array(*[F.lit(w) for w in c.told("warning")]).cast("array<string>").alias("warnings")), "generated_at": now, "last_updated_at": now,
    }))
    first = t.top("market_daily_page_market") + 1
    two = t.spark.createDataFrame([(first, "US", 1), (first + 1, "KR", 2)], "id long, market_type string, display_order short")
    s = summaries.where(F.col("summary_type") == "MARKET_SUMMARY").select(
        "market_type", F.col("title").alias("summary_title"), F.col("body").alias("summary_body"),
        X.market_fields(F.col("metadata_json")).alias("m"),
    )
    empty = F.array().cast("array<string>")
    page_market = two.join(s, "market_type", "left").join(clusters.groupBy("market_type").agg(F.count("*").alias("cluster_count")), "market_type", "left")
    t.append("market_daily_page_market", page_market.withColumns(counts | {
        "page_id": F.lit(page_id), "market_label": V.page_label(F.col("market_type")), "analysis_background_json": F.coalesce("m.background", empty),
        "analysis_key_themes_json": F.coalesce("m.keyThemes", empty), "analysis_outlook": F.col("m.outlook"), "cluster_count": F.coalesce("cluster_count", F.lit(0)),
        "last_updated_at": now, "partial_message": F.lit(None).cast("string"), "metadata_json": F.lit("{}"),
    }))
    of_market = two.select(F.col("id").alias("page_market_id"), "market_type")

    def placed(df: DataFrame, order: list) -> DataFrame:
        return df.join(of_market, "market_type").withColumn("display_order", F.row_number().over(Window.partitionBy("page_market_id").orderBy(*order)))

    def add(name: str, rows: DataFrame) -> None:
        t.append(name, S.with_ids(rows, t.top(name), ["page_market_id", "display_order"]))

    add("market_daily_page_market_index", placed(indices.withColumnRenamed("id", "market_index_daily_id"), ["index_code"]))
    cards = summaries.where(F.col("summary_type") == "CLUSTER_CARD_SUMMARY").select(F.col("cluster_id"), F.nullif("body", F.lit("")).alias("card"))
    shown = clusters.withColumnRenamed("id", "cluster_id").join(cards, "cluster_id", "left").withColumn("summary", F.coalesce("card", "summary_short"))
    add("market_daily_page_market_cluster", placed(shown, ["cluster_rank"]))
    add("market_daily_page_article_link", placed(links, ["cluster_rank", "article_rank", F.col("published_at").desc_nulls_first(), "processed_article_id"]))
    c.page = (page_id, version)
    if status == "PARTIAL":
        _event(c, "BUILD_SNAPSHOT", "WARN", "The page is partial.")
    c.note("log", f"Built page {page_id}, version {version}.")


def finalize_step(t: Tables, c: Run, inputs: Inputs) -> None:
    _complete(t, c)
    _event(c, "FINALIZE_JOB", "INFO", f"Job ended as {c.status}.")


def _complete(t: Tables, c: Run) -> None:
    page_id, version = c.page or (None, None)
    code, message = c.failure or (None, None)
    jobs = S.complete_job(
        t.read("batch_job", [c.day]), c.job_id, F.current_timestamp(), status=c.status, raw_news_count=c.counts["raw_news"], processed_news_count=c.counts["processed_news"],
        cluster_count=c.counts["clusters"], page_id=page_id, page_version_no=version, partial_message=c.partial_message, error_code=code, error_message=message,
        log_summary=" ".join(c.told("log")) or None,
    )
    t.replace("batch_job", jobs, [c.day])


STEPS: list[tuple[str, Callable[[Tables, Run, Inputs], None]]] = [
    ("CREATE_JOB", create_job_step),
    ("COLLECT_NEWS", collect_news_step),
    ("DEDUPE_ARTICLES", dedupe_articles_step),
    ("BUILD_CLUSTERS", build_clusters_step),
    ("COLLECT_INDICES", collect_indices_step),
    ("GENERATE_SUMMARIES", summaries_step),
    ("BUILD_SNAPSHOT", snapshot_step),
    ("FINALIZE_JOB", finalize_step),
]


def run_daily(t: Tables, c: Run, inputs: Inputs, steps=STEPS) -> Run:
    """All steps, an event before and after each, published step by step.

    A failing step leaves the tables as the one before it did; its job fails, and the error is raised.
    """
    for name, step in steps:
        try:
            with t.transaction():
                _event(c, name, "INFO", "Step started.")
                step(t, c, inputs)
                _event(c, name, "INFO", "Step completed.")
                _tell(t, c)
        except Exception as e:
            c.failure = ("BATCH_FAILED", str(e)[:500])
            c.events.clear()
            with t.transaction():
                _event(c, name, "ERROR", "Step failed.")
                _tell(t, c)
                _complete(t, c)
            raise
    return c
