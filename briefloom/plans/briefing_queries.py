"""Queries of the read interface, the lookups and the batch's parts, over the driver's tables in the briefing's shape."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.functions import text as X
from briefloom.functions import values as V
from briefloom.operators import aggregates as A
from briefloom.operators import grouping as G
from briefloom.operators import joins as J
from briefloom.operators import lookup as L
from briefloom.operators import ranking as R
from briefloom.operators import validators
from briefloom.plans import reads
from briefloom.plans.registry import query, table
from briefloom.plans.shapes import Shapes, over
from briefloom.sources import feeds
from briefloom.sources import tables as S

DAY = dt.date(1995, 6, 19)
CLUSTER_DAY = dt.date(2026, 3, 17)
MARKET = "CASE {} WHEN 'US' THEN 1 WHEN 'KR' THEN 2 END"

# Reads -------------------------------------------------------------------------------------


def _flat(page: DataFrame) -> DataFrame:
    """A page's header and, as text, its markets with what hangs on them, in order."""
    text = lambda items, *fields: F.array_join(F.transform(items, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])), ",")
    market = lambda m: F.concat_ws(
        "|", m["marketType"], text(m["indices"], "indexCode", "indexName"), text(m["topClusters"], "clusterId", "title"), text(m["articleLinks"], "processedArticleId", "title")
    )
    markets = F.array_join(F.transform("markets", market), ";")
    return page.select("pageId", "businessDate", "versionNo", "status", "globalHeadline", markets.alias("markets"), F.col("metadata.clusterCount").alias("clusterCount"))


PAGE_TABLES = ("market_daily_page", "market_daily_page_market", "market_daily_page_market_index", "market_daily_page_market_cluster", "market_daily_page_article_link")
_KIDS = "COALESCE((SELECT string_agg({0} || ':' || {1}, ',' ORDER BY display_order, {0}{2}, {1}) FROM {3} x WHERE x.page_market_id = m.id), '')"


def _page_sql(header: str) -> str:
    kids = "|| '|' ||".join(
        (
            _KIDS.format("index_code", "index_name", "", "market_daily_page_market_index"), _KIDS.format("cluster_uid", "title", "", "market_daily_page_market_cluster"),
            _KIDS.format("processed_article_id", "title", "", "market_daily_page_article_link"),
        )
    )
    return over(
        f"""SELECT h.id AS "pageId", h.business_date AS "businessDate", h.version_no AS "versionNo", h.status, h.global_headline AS "globalHeadline",
        COALESCE((SELECT string_agg(m.market_type || '|' || {kids}, ';' ORDER BY m.display_order) FROM market_daily_page_market m WHERE m.page_id = h.id), '') AS markets,
        h.cluster_count AS "clusterCount" FROM ({header}) h""",
        *PAGE_TABLES,
    )


@query(_page_sql("SELECT * FROM market_daily_page ORDER BY business_date DESC, version_no DESC LIMIT 1"))
def read_latest_page(spark, d):
    """The latest page with everything on it."""
    return _flat(reads.latest_page(Shapes(spark, d)))


@query(_page_sql("SELECT * FROM market_daily_page WHERE business_date = DATE '1995-06-19' ORDER BY version_no DESC LIMIT 1"))
def read_page_by_date(spark, d):
    """A day's latest version."""
    return _flat(reads.page_by_date(Shapes(spark, d), DAY))


@query(_page_sql("SELECT * FROM market_daily_page WHERE id = 1203"))
def read_page_by_id(spark, d):
    """E3, F1, F11, F12."""
    return _flat(reads.page_by_id(Shapes(spark, d), 1203))


_ARCHIVE = "SELECT *, row_number() OVER (PARTITION BY business_date ORDER BY version_no DESC, id DESC) AS n FROM market_daily_page WHERE status = 'READY' AND business_date >= DATE '1996-01-01'"


@query(
    over(
        f"""SELECT id AS "pageId", business_date AS "businessDate", version_no AS "versionNo", page_title AS "pageTitle", status, global_headline AS "globalHeadline",
        generated_at AS "generatedAt", partial_message AS "partialMessage" FROM ({_ARCHIVE}) WHERE n = 1 ORDER BY business_date DESC, version_no DESC, id DESC LIMIT 30 OFFSET 30""",
        "market_daily_page",
    )
)
def read_archive(spark, d):
    """The second page of the latest READY version of each day; the page is the feature."""
    return reads.archive(Shapes(spark, d), dt.date(1996, 1, 1), None, "READY", 2, 30)[0]


@query(over(f"SELECT COUNT(*) AS total_count FROM ({_ARCHIVE}) WHERE n = 1", "market_daily_page"))
def read_archive_total(spark, d):
    """E4, A5."""
    return reads.archive(Shapes(spark, d), dt.date(1996, 1, 1), None, "READY")[1]


_UID = "(SELECT cluster_uid FROM news_cluster WHERE id = 77)"


@query(
    over(
        f"""SELECT c.cluster_uid AS "clusterId", c.title, CASE c.market_type WHEN 'US' THEN '미국' ELSE '한국' END AS "marketLabel", p.canonical_title AS representative,
        COALESCE((SELECT string_agg(CAST(m.processed_article_id AS VARCHAR), ',' ORDER BY m.article_rank, m.processed_article_id) FROM news_cluster_article m JOIN news_article_processed a
        ON a.id = m.processed_article_id WHERE m.cluster_id = c.id), '') AS articles, c.article_count AS "articleCount" FROM news_cluster c JOIN news_article_processed p ON p.id = c.representative_article_id
        WHERE c.cluster_uid = {_UID}""",
        "news_cluster", "news_cluster_article", "news_article_processed",
    )
)
def read_cluster_detail(spark, d):
    """A cluster by its uid with its articles in rank order."""
    t = Shapes(spark, d)
    uid = L.by_value(t.read("news_cluster"), "id", 77).first().cluster_uid
    articles = F.array_join(F.transform("articles", lambda a: a["processedArticleId"].cast("string")), ",").alias("articles")
    return reads.cluster_detail(t, uid).select("clusterId", "title", "marketLabel", F.col("representativeArticle.title").alias("representative"), articles, "articleCount")


JOB_SQL = ", ".join(f'{v} AS "{k}"' for k, v in reads.JOB_FIELDS.items())
_JOBS = "FROM batch_job WHERE business_date >= DATE '1996-01-01' AND business_date <= DATE '1998-12-31'"


@query(over(f"SELECT {JOB_SQL} {_JOBS} AND status = 'FAILED' ORDER BY business_date DESC, started_at DESC, job_id DESC LIMIT 20 OFFSET 20", "batch_job"))
def read_job_list(spark, d):
    """A page of jobs; the page is the feature."""
    return reads.job_list(Shapes(spark, d), dt.date(1996, 1, 1), dt.date(1998, 12, 31), "FAILED", 2, 20)[0]


@query(
    over(
        f"""SELECT COUNT(*) AS total_count, COUNT(*) FILTER (WHERE status = 'SUCCESS') AS success_count, COUNT(*) FILTER (WHERE status = 'PARTIAL') AS partial_count,
        COUNT(*) FILTER (WHERE status = 'FAILED') AS failed_count, COALESCE(CAST(ROUND(AVG(duration_seconds)) AS INT), 0) AS avg_duration_seconds {_JOBS}""",
        "batch_job",
    )
)
def read_job_summary(spark, d):
    """E7, A1, A2, A3."""
    return reads.job_list(Shapes(spark, d), dt.date(1996, 1, 1), dt.date(1998, 12, 31))[1]


@query(
    over(
        f"""SELECT {JOB_SQL}, force_run AS "forceRun", rebuild_page_only AS "rebuildPageOnly", error_code AS "errorCode", error_message AS "errorMessage", log_summary AS "logSummary"
        FROM batch_job WHERE job_id = 1203""",
        "batch_job",
    )
)
def read_job_detail(spark, d):
    """E8, F1."""
    return reads.job_detail(Shapes(spark, d), 1203)


# Lookups: order is compared as a column, since results are compared as sets --------------------


def _placed(df: DataFrame, *columns: str) -> DataFrame:
    """The rows with their place in the order they come in, from 0."""
    return S.in_place(df, "place").select("place", *columns)


@query(over(f"SELECT row_number() OVER (ORDER BY {MARKET.format('market_type')}, published_at DESC NULLS LAST, id) - 1 AS place, id, market_type FROM news_article_processed WHERE business_date = DATE '1995-06-19'", "news_article_processed"))
def articles_listed(spark, d):
    """F8: a day's articles, US first, newest first, undated last."""
    return _placed(L.list_articles(Shapes(spark, d).read("news_article_processed"), DAY), "id", "market_type")


@query(over("SELECT id, keyword, priority FROM news_search_keyword WHERE provider_name = 'BUILDING' AND market_type = 'KR' AND is_active", "news_search_keyword"))
def keywords_listed(spark, d):
    """optional equalities."""
    return L.list_keywords(Shapes(spark, d).read("news_search_keyword"), "BUILDING", "KR", True).select("id", "keyword", "priority")


@query(over("SELECT index_code, market_type, close_price FROM market_index_daily WHERE business_date = DATE '1995-06-19'", "market_index_daily"))
def indices_listed(spark, d):
    """F9."""
    return L.list_indices(Shapes(spark, d).read("market_index_daily"), DAY).select("index_code", "market_type", "close_price")


@query(over("SELECT row_number() OVER (ORDER BY cluster_rank) - 1 AS place, id FROM news_cluster WHERE business_date = DATE '2026-03-17' AND market_type = 'KR'", "news_cluster"))
def cluster_ids_listed(spark, d):
    """a market's day, by rank."""
    return _placed(L.list_cluster_ids(Shapes(spark, d).read("news_cluster"), CLUSTER_DAY, "KR"), "id")


@query(over("SELECT id, canonical_title FROM news_article_processed WHERE dedupe_hash = 'h203'", "news_article_processed"))
def article_by_hash(spark, d):
    """F2."""
    return L.by_value(Shapes(spark, d).read("news_article_processed"), "dedupe_hash", "h203").select("id", "canonical_title")


@query(over("SELECT row_number() OVER (ORDER BY generated_at, id) - 1 AS place, id FROM ai_summary WHERE batch_job_id = 7", "ai_summary"))
def summaries_of_job(spark, d):
    """F16."""
    return _placed(L.job_summaries(Shapes(spark, d).read("ai_summary"), 7), "id")


@query(over("SELECT id, generated_at FROM ai_summary WHERE cluster_id = 7 AND summary_type = 'CLUSTER_DETAIL_ANALYSIS' ORDER BY generated_at DESC, id DESC LIMIT 1", "ai_summary"))
def latest_summary(spark, d):
    """T3."""
    return R.latest_cluster_summary(Shapes(spark, d).read("ai_summary"), 7).select("id", "generated_at")


@query(over("SELECT row_number() OVER (ORDER BY article_rank, processed_article_id) - 1 AS place, processed_article_id FROM news_cluster_article WHERE cluster_id = 77", "news_cluster_article"))
def members_listed(spark, d):
    """F15."""
    return _placed(L.cluster_members(Shapes(spark, d).read("news_cluster_article"), 77), "processed_article_id")


@query(over("SELECT row_number() OVER (ORDER BY display_order) - 1 AS place, id, market_type FROM market_daily_page_market WHERE page_id = 1203", "market_daily_page_market"))
def markets_of_page(spark, d):
    """F12."""
    return _placed(L.page_markets(Shapes(spark, d).read("market_daily_page_market"), 1203), "id", "market_type")


@query(over("SELECT EXISTS (SELECT 1 FROM market_daily_page WHERE business_date = DATE '1995-06-19') AS page, EXISTS (SELECT 1 FROM batch_job WHERE business_date = DATE '1995-06-19' AND status IN ('PENDING', 'RUNNING')) AS active", "market_daily_page", "batch_job"))
def day_is_taken(spark, d):
    """F4, F5."""
    t = Shapes(spark, d)
    page, active = L.any_row(L.pages_of(t.read("market_daily_page"), DAY), "page"), L.any_row(L.active_jobs(t.read("batch_job"), DAY), "active")
    return page.join(F.broadcast(active), F.lit(True))  # a row each


@query("SELECT p.p_partkey, p.p_name, r.place FROM (VALUES (7, 0), (3, 1), (11, 2), (3, 3)) r(k, place) JOIN part p ON p.p_partkey = r.k")
def in_order_asked(spark, d):
    """in the order asked for, repeats kept, unknown ids left out."""
    return _placed(L.in_request_order(table(spark, d, "part").select("p_partkey", "p_name"), [7, 3, 999999999, 11, 3], "p_partkey"), "p_partkey", "p_name")


@query(over("SELECT c.id, c.cluster_rank, p.canonical_title AS representative_title, p.published_at AS representative_published_at FROM news_cluster c LEFT JOIN news_article_processed p ON p.id = c.representative_article_id WHERE c.business_date = DATE '2026-03-17'", "news_cluster", "news_article_processed"))
def clusters_with_representative(spark, d):
    """Kept where the representative is missing."""
    t = Shapes(spark, d)
    return J.clusters_with_representative(t.read("news_cluster"), t.read("news_article_processed"), CLUSTER_DAY).select("id", "cluster_rank", "representative_title", "representative_published_at")


@query(over("SELECT c.cluster_uid, m.article_rank, m.processed_article_id, p.published_at FROM news_cluster c JOIN news_cluster_article m ON m.cluster_id = c.id JOIN news_article_processed p ON p.id = m.processed_article_id WHERE c.business_date = DATE '2026-03-17' AND c.market_type = 'US'", "news_cluster", "news_cluster_article", "news_article_processed"))
def links_of_clusters(spark, d):
    """Clusters, members and articles."""
    t = Shapes(spark, d)
    got = J.cluster_article_links(t.read("news_cluster"), t.read("news_cluster_article"), t.read("news_article_processed"), CLUSTER_DAY, "US")
    return got.select("cluster_uid", "article_rank", "processed_article_id", "published_at")


# Functions ---------------------------------------------------------------------------------

_TEXT = "regexp_replace(coalesce(text, ''), '<[^>]+>', '', 'g')"
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _TEXT = f"replace({_TEXT}, '{_entity}', '{_char}')"
_SPACE = r"[\s\v\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
TITLE_SQL = f"trim(regexp_replace({_TEXT}, '{_SPACE}', ' ', 'g'), ' ')"


@query(f"SELECT doc_id, {TITLE_SQL} AS title FROM documents")
def title_normalized(spark, d):
    """Tags out, entities decoded, white space normalised; the SQL decodes those that may occur."""
    return table(spark, d, "documents").select("doc_id", X.normalize_title(F.col("text")).alias("title"))


@query(f"WITH t AS (SELECT doc_id, {TITLE_SQL} AS x FROM documents) SELECT doc_id, CASE WHEN length(x) > 240 THEN rtrim(substring(x, 1, 239), ' ') || '…' ELSE x END AS excerpt FROM t")
def title_excerpt(spark, d):
    """X6."""
    return table(spark, d, "documents").select("doc_id", X.excerpt(F.col("text")).alias("excerpt"))


@query("SELECT page_id, sha256(trim(coalesce(url, '')) || '|' || '' || '|' || 't' || page_id || '|' || '2026-03-17T09:01:02+09:00') AS key FROM pages")
def provider_keys(spark, d):
    """The key of a feed item with the date as it came."""
    date = V.pub_iso(F.lit("Tue, 17 Mar 2026 09:01:02 +0900"))
    return table(spark, d, "pages").select("page_id", X.provider_key(F.col("url"), F.lit(None).cast("string"), F.concat(F.lit(" t"), "page_id", F.lit(" ")), date).alias("key"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE date_trunc('second', ts) - INTERVAL 9 HOUR END AS published_at FROM events""")
def pub_dates(spark, d):
    """X11: RFC 2822 dates read back, null where the offset is missing."""
    offset = F.when(F.col("event_id") % 5 == 0, "").otherwise(" +0900")
    raw = F.concat(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), offset)
    return table(spark, d, "events").select("event_id", V.parse_pub_date(raw).cast("timestamp_ntz").alias("published_at"))


@query("""WITH v AS (SELECT event_id, CAST(ROUND(value * 100) AS HUGEINT) * 1000000 AS n, CAST(user_id % 7 AS HUGEINT) * 100 AS p FROM events),
q AS (SELECT event_id, n, p, (n - p * 1000000) AS m FROM v), r AS (SELECT event_id, m, p, CASE WHEN p > 0 THEN abs(m) // p END AS q, CASE WHEN p > 0 THEN abs(m) % p END AS rest FROM q)
SELECT event_id, CASE WHEN p = 0 THEN 0 ELSE sign(m) * (q + CASE WHEN rest * 2 > p OR (rest * 2 = p AND q % 2 = 1) THEN 1 ELSE 0 END) / 10000.0 END AS change_percent FROM r""")
def change_percent(spark, d):
    """Percent of the value before, rounded once, half to even; 0 where that is 0."""
    e = table(spark, d, "events")
    before = F.pmod("user_id", F.lit(7)).cast("decimal(28,14)")
    return e.select("event_id", V.change(F.round("value", 2).cast("decimal(28,14)"), before)[1].cast("double").alias("change_percent"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(json_extract(props, '$.k') AS INT) WHEN 1 THEN CAST(json_extract(props, '$.k') AS INT) END AS k,
event_id % 4 > 1 AS fell_back FROM events""")
def model_answers_read(spark, d):
    """Fenced and bare objects are read, broken-off texts and arrays fall back."""
    e = table(spark, d, "events")
    kind = F.col("event_id") % 4
    answer = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(kind == 1, F.col("props"))
        .when(kind == 2, F.substring("props", 1, 4)).otherwise(F.concat(F.lit("["), "props", F.lit("]")))
    )
    got = feeds.model_answers(e.select("event_id", answer.alias("answer")), "k int", ["event_id"])
    return got.select("event_id", F.col("a.k").alias("k"), F.col("error").isNotNull().alias("fell_back"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS iso, '글로벌 시장 일간 요약 - ' || strftime(o_orderdate, '%Y-%m-%d') AS title,
CASE WHEN o_custkey % 2 = 0 THEN '미국 증시 일간 요약' ELSE '한국 증시 일간 요약' END AS label, lower(trim(' ' || o_orderpriority || ' ')) AS key, coalesce(nullif(CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'a' END, ''), 'b') AS link,
'{"status":' || CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}' AS json FROM orders""")
def output_fields(spark, d):
    """What pages and payloads show of a row."""
    o = table(spark, d, "orders")
    market = F.when(F.col("o_custkey") % 2 == 0, "US").otherwise("KR")
    link = F.when(F.col("o_custkey") % 3 == 0, "").otherwise("a")
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return o.select(
        "o_orderkey", V.iso(F.col("o_orderdate")).alias("iso"), V.page_title(F.to_date("o_orderdate")).alias("title"), V.page_label(market).alias("label"),
        X.keyword_key(F.concat(F.lit(" "), "o_orderpriority", F.lit(" "))).alias("key"), X.first_link(link, F.lit("b")).alias("link"), X.json_row(status.alias("status")).alias("json"),
    )


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) || '/x' AS joined, CASE WHEN event_type = 'view' THEN 0 ELSE 2 END AS n FROM events")
def json_arrays(spark, d):
    """Arrays out of JSON, null as empty; fields of an object; joined."""
    k = F.from_json("props", "k int")["k"].cast("string")
    raw = F.when(F.col("event_type") != "view", F.to_json(F.array(k, F.lit("x"))))
    return table(spark, d, "events").select("event_id", F.array_join(F.array(k, F.lit("x")), "/").alias("joined"), F.size(X.json_texts(raw)).alias("n"))


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN '' ELSE CAST(json_extract(props, '$.k') AS VARCHAR) || ',b' END AS background, CASE WHEN event_type = 'click' THEN 2 ELSE 0 END AS themes,
CASE WHEN event_id % 3 = 0 THEN 'up' END AS outlook FROM events""")
def market_fields(spark, d):
    """Background, key themes and outlook out of a market summary's metadata."""
    e, k = table(spark, d, "events"), F.get_json_object("props", "$.k")
    raw = F.to_json(
        F.struct(
            F.when(F.col("event_type") != "view", F.array(k, F.lit("b"))).alias("background"), F.when(F.col("event_type") == "click", F.array(k, k)).alias("keyThemes"),
            F.when(F.col("event_id") % 3 == 0, "up").alias("outlook"),
        )
    )
    m = e.select("event_id", X.market_fields(raw).alias("m"))
    return m.select("event_id", F.array_join("m.background", ",").alias("background"), F.size("m.keyThemes").alias("themes"), "m.outlook")


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Body ' || page_id WHEN 1 THEN 'Portal ' || page_id || ' & more' ELSE 'summary ' || page_id END AS body_text,
CASE page_id % 4 WHEN 1 THEN 'http://portal/' || page_id ELSE url END AS fetched_url, page_id % 4 > 1 AS content_fallback_used,
CASE page_id % 4 WHEN 1 THEN 'portal' ELSE regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) END AS source_domain FROM pages""")
def article_bodies(spark, d):
    """An article's body from its origin, else from the portal, else its summary."""
    p = table(spark, d, "pages").select("page_id", "url")
    number, portal = F.col("page_id").cast("string"), F.concat(F.lit("http://portal/"), "page_id")
    articles = p.select("page_id", F.col("url").alias("origin_link"), portal.alias("naver_link"))
    own = F.concat(F.lit("<html><nav>n</nav><article>Body <b>"), number, F.lit("</b><script>x()</script><template>no</template></article>"))
    other = F.concat(F.lit("<div class='a article_view'>Portal "), number, F.lit(" &amp; more</div>"))
    empty = F.lit("<html><body><p>nothing</p></body></html>")
    fetched = p.where("page_id % 4 < 3").select("page_id", "url", F.when(F.col("page_id") % 4 == 0, own).otherwise(empty).alias("html"))
    fetched = fetched.unionByName(p.where("page_id % 4 = 1").select("page_id", portal.alias("url"), other.alias("html")))
    # pages may share a url: each has what was fetched for it
    got = feeds.article_content(articles, fetched.dropDuplicates(["page_id", "url"]), F.concat(F.lit("summary "), number), ["page_id"])
    return got.select("page_id", "body_text", "fetched_url", "content_fallback_used", "source_domain")


# Writes ------------------------------------------------------------------------------------


@query("SELECT user_id, event_type, MIN(event_id) AS event_id FROM events WHERE event_type <> 'error' GROUP BY user_id, event_type")
def insert_ignored(spark, d):
    """The first row of each key the table lacks."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return S.insert_ignore(e, e.where("event_type = 'error'"), ["user_id", "event_type"], [F.col("event_id")])


@query("SELECT o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 10 ELSE 9 + dense_rank() OVER (ORDER BY o_orderpriority) END AS id FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def got_or_created(spark, d):
    """The id of every key, old or new."""
    o = table(spark, d, "orders").select("o_orderpriority")
    existing = spark.createDataFrame([("1-URGENT", 10)], "o_orderpriority string, id long")
    return S.get_or_create(o, existing, ["o_orderpriority"], ["o_orderpriority"])[1]


@query(over("SELECT cluster_id, processed_article_id, article_rank FROM news_cluster_article WHERE cluster_id % 10 <> 3 UNION ALL SELECT p_partkey, p_partkey + i, i FROM part, (VALUES (1), (2)) v(i) WHERE p_partkey % 10 = 3", "news_cluster_article"))
def replaced_set(spark, d):
    """Members of some clusters replaced by arrays of ids, ranked from 1."""
    own = table(spark, d, "part").where("p_partkey % 10 = 3").select(F.col("p_partkey").alias("cluster_id"))
    rows = S.members_of(own.withColumn("article_ids", F.array(F.col("cluster_id") + 1, F.col("cluster_id") + 2)))
    return S.replace_set(Shapes(spark, d).read("news_cluster_article"), rows, own, "cluster_id").withColumn("article_rank", F.col("article_rank").cast("int"))


@query(over("SELECT job_id, CASE WHEN job_id = 1203 THEN 'SUCCESS' ELSE status END AS status, CASE WHEN job_id = 1203 THEN 852 ELSE duration_seconds END AS duration_seconds FROM batch_job", "batch_job"))
def job_completed(spark, d):
    """One job ended, its duration rounded."""
    jobs = Shapes(spark, d).read("batch_job").withColumn("updated_at", F.col("started_at"))
    began = L.by_value(jobs, "job_id", 1203).first().started_at
    return S.complete_job(jobs, 1203, F.lit(began + dt.timedelta(seconds=851, milliseconds=500)), status="SUCCESS").select("job_id", "status", "duration_seconds")


@query(over("SELECT MAX(id) + 1 AS id, ' Bonds ' AS keyword, 'KR' AS market_type, 3 AS priority, true AS is_active FROM news_search_keyword", "news_search_keyword"))
def keyword_created(spark, d):
    """A new keyword's row, numbered on from the greatest id."""
    row = S.new_keyword(Shapes(spark, d).read("news_search_keyword"), "FEED", "KR", " Bonds ", F.current_timestamp(), priority=3)
    return row.select("id", "keyword", "market_type", "priority", "is_active")


@query(over("SELECT job_id, CASE job_id WHEN 7 THEN 70 WHEN 1203 THEN 12030 ELSE page_id END AS page_id, CASE job_id WHEN 7 THEN 2 ELSE page_version_no END AS page_version_no FROM batch_job", "batch_job"))
def seed_cased(spark, d):
    """Columns set by key where a value is given."""
    jobs = Shapes(spark, d).read("batch_job")
    return S.case_update(jobs, "job_id", page_id={7: 70, 1203: 12030}, page_version_no={7: 2}).select("job_id", "page_id", "page_version_no")


# Batch parts -------------------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id AS keyword_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events),
p AS (SELECT keyword_id, event_id, CASE WHEN keyword_id % 3 = 0 AND n >= 20 THEN n + 100 ELSE n END AS place FROM e), c AS (SELECT keyword_id, COUNT(*) FILTER (WHERE place < 100) AS first_page FROM p GROUP BY keyword_id)
SELECT keyword_id, event_id FROM p JOIN c USING (keyword_id) WHERE place < 100 OR (first_page = 100 AND place < 200)""")
def places_served(spark, d):
    """S3: paging ends with a page that isn't full."""
    e = R.ranked(table(spark, d, "events").select(F.col("user_id").alias("keyword_id"), "event_id"), ["keyword_id"], [F.col("event_id")], "n")
    n = F.col("n") - 1
    items = e.withColumn("place", F.when((F.col("keyword_id") % 3 == 0) & (n >= 20), n + 100).otherwise(n))
    return feeds.served(items).select("keyword_id", "event_id")


@query("SELECT event_id, user_id FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-08' AND CAST(ts AS DATE) <= DATE '2024-01-15'")
def history_week(spark, d):
    """The week before a day, the day included."""
    e = table(spark, d, "events").select("event_id", "user_id", F.to_date("ts").alias("date"))
    return feeds.history_window(e, dt.date(2024, 1, 15)).select("event_id", "user_id")


GROUP = "business_date, market_type"
_RANKED = f"""SELECT {GROUP}, id, canonical_title AS t, source_summary AS s, article_body_excerpt AS e,
row_number() OVER (PARTITION BY {GROUP} ORDER BY published_at DESC NULLS LAST, id DESC) AS n FROM news_article_processed"""


@query(
    over(
        """SELECT a.business_date, a.market_type, a.t AS title, COALESCE(a.s, a.e) AS summary_short, COALESCE(l.s, a.e) AS summary_long, a.id AS representative_article_id, k.c AS article_count, k.ids
        FROM r a JOIN k USING (business_date, market_type) LEFT JOIN l USING (business_date, market_type) WHERE a.n = 1""",
        "news_article_processed",
        r=_RANKED,
        k=f"SELECT {GROUP}, CAST(COUNT(*) AS INT) AS c, string_agg(CAST(id AS VARCHAR), ',' ORDER BY n) AS ids FROM r GROUP BY {GROUP}",
        l=f"""SELECT {GROUP}, string_agg(s, ' / ' ORDER BY n) AS s FROM (SELECT *, row_number() OVER (PARTITION BY {GROUP} ORDER BY n) AS place FROM r WHERE s IS NOT NULL)
        WHERE place <= 3 GROUP BY {GROUP}""",
    )
)
def groups_described(spark, d):
    """What stands in for a model's view of each market's day."""
    got = G.described(Shapes(spark, d).read("news_article_processed"), ["business_date", "market_type"])
    ids = F.array_join(F.transform("article_ids", lambda i: i.cast("string")), ",").alias("ids")
    return got.select("business_date", "market_type", "title", "summary_short", "summary_long", "representative_article_id", "article_count", ids)


_ANSWER = "date_part('day', business_date) % 4"


@query(
    over(
        f"""SELECT business_date, market_type, CASE {_ANSWER} WHEN 0 THEN 'Answered ' || market_type ELSE r.t END AS title, CASE {_ANSWER} WHEN 0 THEN 'a,b' ELSE '' END AS tags,
        CASE WHEN {_ANSWER} = 0 AND k.c > 1 THEN b.id ELSE r.id END AS representative_article_id, {_ANSWER} > 1 AS fallback_used,
        CASE {_ANSWER} WHEN 2 THEN 'The answer is not a JSON object.' END AS error
        FROM r JOIN k USING ({GROUP}) LEFT JOIN (SELECT business_date, market_type, id FROM r WHERE n = 2) b USING ({GROUP}) WHERE r.n = 1""",
        "news_article_processed",
        r=_RANKED,
        k=f"SELECT {GROUP}, COUNT(*) AS c FROM r GROUP BY {GROUP}",
    )
)
def groups_answered(spark, d):
    """A model's answers over what stands in for them, field by field; broken-off and missing ones fall back."""
    keys = ["business_date", "market_type"]
    groups = G.described(Shapes(spark, d).read("news_article_processed"), keys).withColumn("tags_json", F.array().cast("array<string>"))
    kind = F.dayofmonth("business_date") % 4
    answer = (
        F.when(kind == 0, F.concat(F.lit('```json\n{"title":"Answered '), "market_type", F.lit('","tags":["a","b"],"representative_article_index":1}\n```')))
        # the first index outside the group, however large that is
        .when(kind == 1, F.concat(F.lit('{"title":"","tags":[],"representative_article_index":'), "article_count", F.lit("}"))).otherwise(F.lit('{"title":'))
    )
    raw = groups.where(kind < 3).select(*keys, answer.alias("answer"))
    fields = "title string, summary_short string, summary_long string, tags array<string>, analysis_paragraphs array<string>, representative_article_index int"
    got = G.answered(groups, feeds.model_answers(raw, fields, keys), keys)
    return got.select(*keys, "title", F.array_join("tags_json", ",").alias("tags"), "representative_article_id", "fallback_used", "error")


@query(over("SELECT CAST(COUNT(*) FILTER (WHERE fallback_used) AS BIGINT) AS fallback_count FROM ai_summary", "ai_summary"))
def fallbacks_counted(spark, d):
    """A10."""
    return A.fallback_count(Shapes(spark, d).read("ai_summary"))


@query(over("SELECT 'counts' AS rule, CAST(job_id AS VARCHAR) AS detail FROM batch_job WHERE raw_news_count > 50 UNION ALL SELECT 'member', CAST(c.id AS VARCHAR) FROM news_cluster c WHERE NOT EXISTS (SELECT 1 FROM news_cluster_article m WHERE m.cluster_id = c.id AND m.processed_article_id = c.representative_article_id)", "batch_job", "news_cluster", "news_cluster_article"))
def rules_broken(spark, d):
    """A representative that is no member; a count outside its range."""
    t, names = Shapes(spark, d, dealt=True), ("news_cluster", "news_cluster_article")
    rules = [r for r in validators.RULES if r.rule == "representative is a member"]
    found = validators.violations({n: t.read(n) for n in names}, rules, t.tasks(*names)).drop("n_rows")
    jobs = validators.broken(t.read("batch_job"), "counts", F.col("raw_news_count") <= 50, F.col("job_id"))
    return jobs.unionByName(found.withColumn("rule", F.lit("member")))


def _repeats(rule: str, t: str, *keys: str, where: str = "true") -> str:
    full = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return f"SELECT '{rule}' AS rule, concat_ws('|', {', '.join(keys)}) AS detail, COUNT(*) AS n_rows FROM {t} WHERE {where} AND {full} GROUP BY {', '.join(keys)} HAVING COUNT(*) > 1"


def _lacks(rule: str, t: str, keys: str, parent: str, parents: str = "id") -> str:
    ks, ps = keys.split(), parents.split()
    on, full = " AND ".join(f"p.{b} = c.{a}" for a, b in zip(ks, ps)), " AND ".join(f"c.{k} IS NOT NULL" for k in ks)
    return f"SELECT '{rule}', CAST(c.{ks[0]} AS VARCHAR), COUNT(*) FROM {t} c WHERE {full} AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE {on}) GROUP BY {', '.join('c.' + k for k in ks)}"


def _fails(rule: str, t: str, condition: str, detail: str) -> str:
    return f"SELECT '{rule}', CAST({detail} AS VARCHAR), COUNT(*) FROM {t} WHERE NOT ({condition}) GROUP BY {detail}"


_N = "raw_news_count >= 0 AND processed_news_count >= 0 AND cluster_count >= 0"
_ON_PAGE = ("market_daily_page_market_index", "market_daily_page_market_cluster", "market_daily_page_article_link")
VALIDATED = ("batch_job", "news_article_processed", "news_cluster", "news_cluster_article", "news_search_keyword", "ai_summary", *PAGE_TABLES)
_VIOLATIONS = " UNION ALL ".join(
    (
        _repeats("one active job a day", "batch_job", "business_date", where="status IN ('PENDING', 'RUNNING')"), _repeats("dedupe hash", "news_article_processed", "dedupe_hash"),
        _repeats("cluster rank", "news_cluster", "business_date", "market_type", "cluster_rank"), _repeats("cluster uid", "news_cluster", "cluster_uid"),
        _lacks("representative is a member", "news_cluster", "id representative_article_id", "news_cluster_article", "cluster_id processed_article_id"),
        _repeats("article rank", "news_cluster_article", "cluster_id", "article_rank"), _repeats("member", "news_cluster_article", "cluster_id", "processed_article_id"),
        _repeats("page version", "market_daily_page", "business_date", "version_no"), _repeats("market order", "market_daily_page_market", "page_id", "display_order"),
        _repeats("page market", "market_daily_page_market", "page_id", "market_type"), *(_repeats(f"{n} order", n, "page_market_id", "display_order") for n in _ON_PAGE),
        *(_lacks(f"{n} parent", n, "page_market_id", "market_daily_page_market") for n in _ON_PAGE), _repeats("keyword", "news_search_keyword", "provider_name", "market_type", "lower(trim(keyword))"),
        _fails("keyword not blank", "news_search_keyword", "trim(keyword) <> '' AND trim(provider_name) <> ''", "id"), _fails("priority above 0", "news_search_keyword", "priority > 0", "id"),
        _fails("job counts", "batch_job", f"{_N} AND duration_seconds >= 0", "job_id"), _fails("job times", "batch_job", "ended_at >= started_at", "job_id"),
        _fails("job scope", "batch_job", "market_scope = 'GLOBAL'", "job_id"), _fails("page counts", "market_daily_page", f"{_N} AND version_no > 0", "id"),
        _fails("market counts", "market_daily_page_market", f"{_N} AND display_order > 0", "id"), _lacks("member cluster", "news_cluster_article", "cluster_id", "news_cluster"),
        _lacks("member article", "news_cluster_article", "processed_article_id", "news_article_processed"), _lacks("market page", "market_daily_page_market", "page_id", "market_daily_page"),
        _fails("batch_job status", "batch_job", "status IN ('PENDING', 'RUNNING', 'SUCCESS', 'PARTIAL', 'FAILED')", "status"), _fails("batch_job trigger_type", "batch_job", "trigger_type IN ('SCHEDULED', 'MANUAL', 'ADMIN_REBUILD')", "trigger_type"),
        _fails("news_cluster market_type", "news_cluster", "market_type IN ('US', 'KR')", "market_type"), _fails("market_daily_page status", "market_daily_page", "status IN ('READY', 'PARTIAL', 'FAILED')", "status"),
        _fails("ai_summary status", "ai_summary", "status IN ('SUCCESS', 'FAILED', 'FALLBACK')", "status"),
        _fails("ai_summary summary_type", "ai_summary", "summary_type IN ('GLOBAL_HEADLINE', 'MARKET_SUMMARY', 'CLUSTER_CARD_SUMMARY', 'CLUSTER_DETAIL_ANALYSIS')", "summary_type"),
    )
)


@query(over(_VIOLATIONS, *VALIDATED))
def violations_listed(spark, d):
    """Every rule over all tables that the shapes have, one scan a table."""
    t = Shapes(spark, d, dealt=True)
    return validators.violations({n: t.read(n) for n in VALIDATED}, tasks=t.tasks(*VALIDATED))
