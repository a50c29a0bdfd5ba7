"""The daily batch, its reads and the streaming intake, end to end on small tables."""

import datetime as dt
import json

import pytest

from briefloom.operators import validators
from briefloom.plans import reads, steps
from briefloom.sources import tables as S
from briefloom.sources.store import Conflict, Tables
from briefloom.streaming.ingest import ingest

DAY = dt.date(2026, 3, 17)
NOW = dt.datetime(2026, 3, 18, 6)


def item(title, origin, link, pub, description="d"):
    return json.dumps({"title": title, "originallink": origin, "link": link, "pubDate": pub, "description": description}, ensure_ascii=False)


@pytest.fixture
def tables(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}/store")
    rows = [(1, "FEED", "US", "nasdaq", True, 1, NOW, NOW), (2, "FEED", "KR", "kospi", True, 1, NOW, NOW), (3, "FEED", "KR", "off", False, 2, NOW, NOW)]
    t.append("news_search_keyword", spark.createDataFrame(rows, t.read("news_search_keyword").schema))
    return t


@pytest.fixture
def inputs(spark):
    day = "Tue, 17 Mar 2026 0{}:00:00 +0900"
    items = [
        (1, 0, item("Later day", "http://n/l", "", "Wed, 18 Mar 2026 09:00:00 +0900")),
        (1, 1, item("<b>Fed</b> rate cut hopes", "http://n/a/", "http://p/a", day.format(9), "Fed &amp; rates")),
        (1, 2, item("Fed rate cut hopes", "http://N/a", "http://p/b", day.format(8))),
        (1, 3, item("No date", "http://n/x", "", "soon")),
        (1, 4, item("Chip fund rate rally", "http://n/c", "", day.format(7))),
        (1, 5, item("Day before", "http://n/o", "", "Mon, 16 Mar 2026 09:00:00 +0900")),
        (1, 6, item("After the stop", "http://n/s", "", day.format(6))),
        (2, 0, item("코스피 상승 마감", "http://k/a", "", day.format(5))),
    ]
    history = [
        ("^GSPC", dt.date(2026, 3, 13), 99.0, 101.0, 98.0, 100.0), ("^GSPC", DAY, 100.0, 102.0, 99.0, 101.5), ("^GSPC", dt.date(2026, 3, 18), 1.0, 1.0, 1.0, 1.0),
        ("^KS11", dt.date(2026, 3, 16), 50.0, None, None, 40.0),
    ]
    return steps.Inputs(
        items=spark.createDataFrame(items, "keyword_id long, place int, item string"),
        fetched_pages=spark.createDataFrame([("http://p/a", "<article>Body of the <b>article</b></article>")], "url string, html string"),
        history=spark.createDataFrame(history, "ticker string, date date, open double, high double, low double, close double"),
        grouping=True,
    )


def test_daily_batch(spark, tables, inputs):
    c = steps.run_daily(tables, steps.start_job(tables, DAY), inputs)
    assert (c.counts["raw_news"], c.counts["processed_news"], c.counts["clusters"]) == (4, 3, 3)
    processed = {r.canonical_title: r for r in tables.read("news_article_processed").collect()}
    first = processed["Fed rate cut hopes"]
    assert first.origin_link == "http://n/a" and first.source_summary == "Fed & rates" and first.article_body_excerpt == "Body of the article"
    assert tables.read("news_article_raw_processed_map").count() == 4
    quotes = {r.index_code: r for r in tables.read("market_index_daily").collect()}
    assert float(quotes["^GSPC"].change_value) == 1.5 and float(quotes["^GSPC"].change_percent) == 1.5
    assert float(quotes["^KS11"].change_value) == -10 and quotes["^KS11"].high_price is None
    assert c.told("warning") == ["^KS11 is of an earlier day."]
    assert tables.read("ai_summary").count() == 1 + 2 + 2 * 3 == c.counts["summaries"] == c.counts["fallbacks"]
    job = reads.job_detail(tables, c.job_id).first()
    assert job.status == "PARTIAL" and job.pageVersionNo == 1 and job.durationSeconds >= 0
    page = reads.latest_page(tables).first()
    assert [m.marketType for m in page.markets] == ["US", "KR"] and page.status == "PARTIAL"
    us = page.markets[0]
    assert [x.indexCode for x in us.indices] == ["^GSPC"] and [x.title for x in us.topClusters] == ["Fed rate cut hopes", "Chip fund rate rally"]
    assert us.topClusters[0].representativeArticle.naverLink == "http://p/a" and len(us.articleLinks) == 2 and us.metadata.rawNewsCount == 4
    assert page.globalHeadline == "Fed rate cut hopes / Chip fund rate rally"
    names = [n for n in ("batch_job", "batch_job_event", "news_article_raw", "news_article_processed", "news_cluster", "news_cluster_article", "market_daily_page",
                         "market_daily_page_market", "market_daily_page_market_index", "market_daily_page_market_cluster", "market_daily_page_article_link")]
    assert validators.violations({n: tables.read(n) for n in names}).collect() == []

    with pytest.raises(steps.JobRejected, match="PAGE_ALREADY_EXISTS"):
        steps.start_job(tables, DAY)
    uid = us.topClusters[0].clusterId
    detail = reads.cluster_detail(tables, uid).first()
    assert detail.marketLabel == "미국" and [a.title for a in detail.articles] == ["Fed rate cut hopes"]
    told = [(r.level, json.loads(r.context_json)) for r in tables.read("batch_job_event").where("message = 'Cluster created.'").orderBy("id").collect()]
    assert [(level, x["marketType"], x["clusterRank"], x["articleCount"]) for level, x in told] == [("INFO", "US", 1, 1), ("INFO", "US", 2, 1), ("INFO", "KR", 1, 1)]
    # once more: nothing new is collected, clusters get new ids, a version is added, old cards lose their cluster
    again = steps.run_daily(tables, steps.start_job(tables, DAY, force=True), inputs)
    assert (again.counts["raw_news"], again.counts["processed_news"], again.page[1]) == (0, 3, 2)
    assert tables.read("news_cluster").count() == 3 and tables.read("news_article_processed").count() == 3
    old = tables.read("market_daily_page_market_cluster").where("id <= 3")
    assert old.where("cluster_id is not null").isEmpty() and old.where("cluster_uid is null").isEmpty()
    now = {r.cluster_uid for r in tables.read("news_cluster").collect()}
    assert len(now) == 3 and not now & {r.cluster_uid for r in old.collect()}
    with pytest.raises(reads.NotFound, match="CLUSTER_NOT_FOUND"):
        reads.cluster_detail(tables, uid)
    items, total = reads.archive(tables, status="PARTIAL")
    assert total.first()[0] == 1 and [r.versionNo for r in items.collect()] == [2]
    listed, summary = reads.job_list(tables)
    assert [r.jobId for r in listed.collect()] == [2, 1] and summary.first().partial_count == 2
    assert reads.page_by_date(tables, DAY, 1).first().versionNo == 1 and reads.page_by_id(tables, again.page[0]).first().versionNo == 2


def test_one_cluster_a_market_without_grouping(tables, inputs):
    inputs.grouping = False
    c = steps.run_daily(tables, steps.start_job(tables, DAY), inputs)
    assert c.counts["clusters"] == 2


def test_nothing_to_do(spark, tables):
    empty = steps.Inputs(items=spark.createDataFrame([], "keyword_id long, place int, item string"))
    c = steps.run_daily(tables, steps.start_job(tables, DAY), empty)
    assert c.failure[0] == "SNAPSHOT_SOURCE_MISSING" and c.page is None
    assert c.partial_message == f"{steps.NO_INDICES}; {steps.NO_CLUSTERS}" and c.status == "FAILED"
    events = [r.message for r in tables.read("batch_job_event").orderBy("id").collect()]
    assert events.count("Step started.") == 8 and events.count("Step completed.") == 8
    for read, code in ((lambda: reads.latest_page(tables), "LATEST"), (lambda: reads.page_by_date(tables, DAY), "PAGE_NOT"), (lambda: reads.job_detail(tables, 9), "JOB")):
        with pytest.raises(reads.NotFound, match=code):
            read()


def test_a_failing_step_fails_the_job(tables):
    c = steps.start_job(tables, DAY)
    with pytest.raises(steps.JobRejected, match="BATCH_ALREADY_RUNNING"):
        steps.start_job(tables, DAY)
    with pytest.raises(ValueError):
        steps.run_daily(tables, c, steps.Inputs())
    assert reads.job_detail(tables, c.job_id).first().status == "FAILED"
    assert tables.read("batch_job_event").where("level = 'ERROR'").count() == 1


def test_streaming_intake_is_idempotent(spark, tables, tmp_path):
    raw = tables.read("news_article_raw")
    rows = [(0, "FEED", k, "US", DAY, None, f"t{k}", None, NOW, None, None, "{}", NOW, NOW) for k in ("a", "b", "a")]
    source = f"file://{tmp_path}/source"
    spark.createDataFrame(rows, raw.schema).write.parquet(source)
    for run in ("one", "two"):
        ingest(spark.readStream.schema(raw.schema).parquet(source), tables, f"file://{tmp_path}/{run}").awaitTermination(120)
        got = tables.read("news_article_raw").select("id", "provider_article_key").collect()
        assert sorted(tuple(r) for r in got) == [(1, "a"), (2, "b")]


def test_a_day_answered_by_the_model_is_a_success(spark, tables, inputs):
    """Answers field by field over the fallbacks; what is missing or breaks off falls back and is told."""
    raw = lambda rows, keys: spark.createDataFrame(rows, f"{keys}answer string, error string")
    cluster = "market_type string, group_no int, "
    inputs.history = inputs.history.where("ticker = '^GSPC'")
    inputs.model_name = "m1"
    inputs.cluster_answers = raw(
        [("US", 1, '```json\n{"title":"Fed eyes cuts","tags":["fed"],"representative_article_index":7}\n```', None), ("US", 2, '{"summary_short":"Chips up"}', None),
         ("KR", 1, '{"title":""}', None)], cluster,
    )
    inputs.headline_answers = raw([('{"title":"Markets rise","body":"b"}', None)], "")
    inputs.market_answers = raw([("US", '{"body":"US body","key_themes":["rates"]}', None), ("KR", '{"title":"KR title","outlook":"up"}', None)], "market_type string, ")
    inputs.card_answers = raw([("US", 1, '{"body":"card"}', None), ("US", 2, "{}", None), ("KR", 1, '{"title":"k"}', None)], cluster)
    inputs.detail_answers = raw([("US", 1, '{"paragraphs":["p1","p2"]}', None), ("US", 2, "{}", None), ("KR", 1, "{}", None)], cluster)
    c = steps.run_daily(tables, steps.start_job(tables, DAY), inputs)
    assert (c.status, c.counts["fallbacks"], c.counts["summaries"]) == ("SUCCESS", 0, 9)
    page = reads.latest_page(tables).first()
    us, kr = page.markets
    assert (page.status, page.globalHeadline, us.summaryBody, us.analysis.keyThemes, kr.summaryTitle, kr.analysis.outlook) == (
        "READY", "Markets rise", "US body", ["rates"], "KR title", "up"
    )
    assert [(x.title, x.summary) for x in us.topClusters] == [("Fed eyes cuts", "card"), ("Chip fund rate rally", "Chips up")] and us.topClusters[0].tags == ["fed"]
    rows = tables.read("ai_summary").collect()
    assert {(r.status, r.fallback_used, r.model_name, r.error_message) for r in rows} == {("SUCCESS", False, "m1", None)}
    assert [r.paragraphs_json for r in rows if r.summary_type == "CLUSTER_DETAIL_ANALYSIS"][0] == ["p1", "p2"]
    assert json.loads(next(r.metadata_json for r in rows if r.summary_type == "GLOBAL_HEADLINE")) == {"reason": "llm"}
    # the same day once more with answers that break off, fail or are missing
    inputs.cluster_answers = raw([("US", 1, '{"title":', None)], cluster)
    inputs.headline_answers = raw([(None, "timeout")], "")
    inputs.detail_answers = raw([("US", 1, "[1]", None)], cluster)
    again = steps.run_daily(tables, steps.start_job(tables, DAY, force=True), inputs)
    assert again.status == "PARTIAL" and again.counts["fallbacks"] == 1 + 3
    head = tables.read("ai_summary").where(f"batch_job_id = {again.job_id} and summary_type = 'GLOBAL_HEADLINE'").first()
    assert (head.status, head.error_message, head.model_name) == ("FALLBACK", "timeout", None)
    assert json.loads(head.metadata_json) == {"reason": "llm_fallback", "error": {"message": "timeout"}}
    warned = tables.read("batch_job_event").where(f"batch_job_id = {again.job_id} and message = 'Cluster enrichment used the fallback.'").orderBy("id").collect()
    assert [json.loads(r.context_json)["error"]["message"] for r in warned][:1] == ["The answer is not a JSON object."] and len(warned) == 3


def test_keywords_and_seed(spark, tables):
    row = tables.create_keyword("FEED", "KR", " KOSDAQ ", priority=3).first()
    assert (row.id, row.keyword, row.priority, row.is_active) == (4, " KOSDAQ ", 3, True)
    for bad in (("FEED", "KR", "kosdaq"), (" ", "KR", "x"), ("FEED", "JP", "x"), ("FEED", "KR", "  ")):
        with pytest.raises(ValueError):
            tables.create_keyword(*bad)
    with pytest.raises(ValueError):
        tables.create_keyword("FEED", "KR", "y", priority=0)
    assert tables.read("news_search_keyword").count() == 4
    jobs = [(1001, "J", DAY, "SUCCESS", 851), (1002, "J", DAY, "PARTIAL", 1275), (1003, "J", DAY, "FAILED", 132), (1004, "J", DAY, "SUCCESS", 894)]
    seed = spark.createDataFrame(jobs, "job_id long, job_name string, business_date date, status string, duration_seconds int")
    tables.load_seed({"batch_job": seed})
    got = reads.job_list(tables)[1].first()
    assert (got.total_count, got.success_count, got.partial_count, got.failed_count, got.avg_duration_seconds) == (4, 2, 1, 1, 788)
    paged = S.case_update(tables.read("batch_job"), "job_id", page_id={1001: 2001, 1004: 2002}, page_version_no={1001: 1, 1004: 1})
    assert [(r.job_id, r.page_id, r.page_version_no) for r in paged.orderBy("job_id").collect()] == [(1001, 2001, 1), (1002, None, None), (1003, None, None), (1004, 2002, 1)]
    with pytest.raises(ValueError):
        tables.load_seed({"no_such_table": seed})
