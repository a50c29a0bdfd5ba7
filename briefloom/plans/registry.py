"""Queries over the driver's tables, by name, and the SQL each one must agree with.

The driver's tables hold no news, so each operator runs on a table of the same shape.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.functions import text as X
from briefloom.functions import values as V
from briefloom.functions.html import body_text
from briefloom.operators import aggregates as A
from briefloom.operators import grouping as G
from briefloom.operators import joins as J
from briefloom.operators import lookup as L
from briefloom.operators import ranking as R
from briefloom.operators import validators
from briefloom.plans.steps import status_policy
from briefloom.schemas import enum_order
from briefloom.sources import tables as S

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
EVENT_TYPES = ("view", "click", "purchase")


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""SELECT user_id, event_id, ts, event_type, value FROM events WHERE event_type <> 'view'
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_per_key(spark, d):
    """Filter first, then the latest row of each key."""
    e = table(spark, d, "events").where(L.conjunction(F.col("event_type") != "view", None))
    return R.first_per_key(e.select("user_id", "event_id", "ts", "event_type", "value"), ["user_id"], [F.desc("ts"), F.desc("event_id")])


@query("SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_one(spark, d):
    """T1."""
    pages = table(spark, d, "events").select(F.col("event_id").alias("version_no"), F.col("ts").alias("business_date"), "user_id")
    return R.latest_page(pages).select(F.col("version_no").alias("event_id"), F.col("business_date").alias("ts"), "user_id")


@query("""SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderstatus = 'O'
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40""")
def paged_list(spark, d):
    """The third page of a filtered list; the page is the feature."""
    page, size, _ = R.pagination(3, 20)
    passing = L.date_status_filter("o_orderdate", dt.datetime(1995, 1, 1), None, "O", "o_orderstatus")
    o = table(spark, d, "orders").where(passing).select("o_orderkey", "o_orderdate", "o_totalprice")
    return R.paged(o.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")), page, size)


@query("SELECT COUNT(DISTINCT CAST(o_orderdate AS DATE)) AS total_count FROM orders WHERE o_orderstatus = 'F'")
def archive_count(spark, d):
    """A5."""
    return A.distinct_days(table(spark, d, "orders").withColumn("business_date", F.to_date("o_orderdate")), F.col("o_orderstatus") == "F")


@query("""SELECT COUNT(*) AS total_count, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS success_count,
COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS partial_count, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS failed_count,
COALESCE(CAST(ROUND(AVG(CAST(FLOOR(o_totalprice) AS BIGINT))) AS INT), 0) AS avg_duration_seconds FROM orders""")
def status_summary(spark, d):
    """A1, A2, A3: counts by status and a rounded mean, one row always."""
    names = F.when(F.col("o_orderstatus") == "O", "SUCCESS").when(F.col("o_orderstatus") == "P", "PARTIAL").otherwise("FAILED")
    return A.status_summary(table(spark, d, "orders").select(names.alias("status"), F.floor("o_totalprice").alias("duration_seconds")))


@query("SELECT COALESCE(MAX(l_linenumber), 0) + 1 AS next_l_linenumber FROM lineitem WHERE l_returnflag = 'R'")
def next_version(spark, d):
    """A4."""
    return A.next_number(L.by_value(table(spark, d, "lineitem"), "l_returnflag", "R"), "l_linenumber")


@query("""SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY
CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 WHEN '5-LOW' THEN 5 END NULLS LAST,
o_orderdate DESC NULLS LAST, o_orderkey) AS display_order FROM orders""")
def enum_sort_rank(spark, d):
    """Ranks by declared order, newest first, key."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    order = [enum_order("o_orderpriority", PRIORITIES).asc_nulls_last(), F.desc_nulls_last("o_orderdate"), F.col("o_orderkey")]
    return R.ranked(o, ["o_custkey"], order, "display_order").select("o_orderkey", "o_orderpriority", "display_order")


@query("SELECT c.c_custkey, c.c_name, n.n_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey AND n.n_regionkey = 1")
def left_rep_join(spark, d):
    """Kept without a partner."""
    none = F.lit(None).cast("string")
    articles = table(spark, d, "nation").where("n_regionkey = 1").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("canonical_title"), *[none.alias(c) for c in ("publisher_name", "published_at", "origin_link", "naver_link")]
    )
    clusters = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("representative_article_id"), F.lit("US").alias("market_type"), F.col("c_custkey").alias("cluster_rank"))
    return J.clusters_with_representative(clusters, articles).select("c_custkey", "c_name", F.col("representative_title").alias("n_name"))


@query("""SELECT o.o_orderkey, l.l_linenumber, p.p_name, l.l_quantity FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
JOIN part p ON l.l_partkey = p.p_partkey WHERE o.o_orderstatus = 'P'""")
def three_way_links(spark, d):
    """J2."""
    none, o = F.lit(None).cast("string"), table(spark, d, "orders").where("o_orderstatus = 'P'")
    clusters = o.select(F.col("o_orderkey").alias("id"), none.alias("cluster_uid"), none.alias("title"), F.lit("US").alias("market_type"), F.col("o_orderkey").alias("cluster_rank"))
    line = F.struct("l_linenumber", "l_quantity")
    members = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cluster_id"), F.col("l_partkey").alias("processed_article_id"), line.alias("article_rank"))
    articles = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("canonical_title"), *[none.alias(c) for c in ("publisher_name", "published_at", "origin_link", "naver_link")])
    got = J.cluster_article_links(clusters, members, articles)
    return got.select(F.col("cluster_id").alias("o_orderkey"), "article_rank.l_linenumber", F.col("title").alias("p_name"), "article_rank.l_quantity")


@query("""SELECT o.o_orderkey, COALESCE(string_agg(l.l_linenumber || ':' || l.l_partkey, ',' ORDER BY l.l_linenumber, l.l_partkey), '') AS lines
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey""")
def nested_children(spark, d):
    """Children of each parent as an ordered array, empty where there are none."""
    item = F.concat_ws(":", "l_linenumber", "l_partkey").alias("item")
    l = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    out = J.with_nested(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", J.nested(l, "o_orderkey", ["l_linenumber", "l_partkey"], [item], "kids"), "kids")
    return out.select("o_orderkey", F.array_join(F.transform("kids", lambda k: k["item"]), ",").alias("lines"))


@query("""WITH e AS (SELECT CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS kind, user_id, value, ts, event_id FROM events),
last AS (SELECT kind, user_id, arg_max(value, (ts, event_id)) AS last_value FROM e GROUP BY kind, user_id),
ask AS (SELECT DISTINCT kind, user_id FROM e)
SELECT a.kind, a.user_id, l.last_value FROM ask a LEFT JOIN last l ON a.kind IS NOT DISTINCT FROM l.kind AND a.user_id IS NOT DISTINCT FROM l.user_id""")
def lastwins_nullsafe(spark, d):
    """Last row of each key, looked up with null keys equal."""
    e = table(spark, d, "events").select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"), "user_id", "value", "ts", "event_id")
    return J.null_safe_lookup(e.select("kind", "user_id").distinct(), J.last_of(e, ["kind", "user_id"], ["ts", "event_id"]), ["kind", "user_id"], {"last_value": "value"})


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_insert(spark, d):
    """Rows whose key isn't there yet."""
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return J.not_in(table(spark, d, "customer").select("c_custkey", "c_name"), o, ["c_custkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_in(spark, d):
    """J7, F11."""
    o = table(spark, d, "orders").where("o_orderstatus = 'P'")
    return L.children_of(table(spark, d, "customer").select("c_custkey", "c_name"), o, "c_custkey", "o_custkey")


@query("""SELECT p.p_partkey, p.p_name, r.place FROM (VALUES (7, 0), (3, 1), (999999999, 2), (11, 3), (3, 4)) r(k, place) JOIN part p ON p.p_partkey = r.k""")
def request_order(spark, d):
    """in the order asked for; the place stands in a column, since results are compared as sets."""
    ids = [7, 3, 999999999, 11, 3]
    return L.in_request_order(table(spark, d, "part").select("p_partkey", "p_name"), ids, "p_partkey", "place")


@query("""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, ts, event_id, CAST(value AS DECIMAL(20,8)) AS close FROM events WHERE ts <= TIMESTAMP '2024-06-30'),
r AS (SELECT *, row_number() OVER w AS n, lead(close) OVER w AS prev FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC))
SELECT user_id, CAST(round_even(close, 4) AS DOUBLE) AS close_price,
CAST(round_even(close - COALESCE(prev, close), 4) AS DOUBLE) AS change_value FROM r WHERE n = 1""")
def asof_prev(spark, d):
    """The last value not after a day, and its change on the one before."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.struct("ts", "event_id").alias("at"), F.col("value").cast("decimal(20,8)").alias("close"))
    got = J.as_of(e.where(F.col("ts") <= F.lit("2024-06-30").cast("timestamp")), ["user_id"], F.col("at"), "at", ["close"])
    diff, _ = V.change(F.col("close"), F.coalesce("previous_close", "close"))
    return got.select("user_id", V.quantized(F.col("close")).cast("double").alias("close_price"), diff.cast("double").alias("change_value"))


@query()
def asof_percent(spark, d):
    """The change in percent of the value before; not SQL (decimal division): tested against decimals."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.struct("ts", "event_id").alias("at"), F.col("value").cast("decimal(20,8)").alias("close"))
    got = J.as_of(e.where(F.col("ts") <= F.lit("2024-06-30").cast("timestamp")), ["user_id"], F.col("at"), "at", ["close"])
    _, percent = V.change(F.col("close"), F.coalesce("previous_close", "close"))
    return got.select("user_id", percent.alias("change_percent"))


@query("""SELECT event_id, user_id, ts FROM (SELECT *, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER
(PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS stop FROM events) WHERE stop = 0""")
def take_while(spark, d):
    """Rows before a key's first stop."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", F.struct("ts", "event_id").alias("place"))
    return R.take_while(e, ["user_id"], "place", F.col("event_type") == "purchase").select("event_id", "user_id", "ts")


SQL_SPACE = "[\\s\\v\\x1c-\\x1f\\x85\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


@query(f"""SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '{SQL_SPACE}', ' ', 'g'), ' ') AS normalized FROM documents""")
def text_normalize(spark, d):
    """X2."""
    return table(spark, d, "documents").select("doc_id", X.normalize_whitespace(F.col("text")).alias("normalized"))


LINK = "regexp_extract(url, '^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:[?]([^#]*))?(?:#.*)?$', {})"


@query(f"""SELECT page_id, lower({LINK.format(1)}) || '://' || lower({LINK.format(2)}) || regexp_replace({LINK.format(3)}, '/+$', '') ||
CASE WHEN {LINK.format(4)} <> '' THEN '?' || {LINK.format(4)} ELSE '' END AS link, nullif({LINK.format(2)}, '') AS domain FROM pages""")
def link_canonical(spark, d):
    """X4, X23."""
    return table(spark, d, "pages").select("page_id", X.canonicalize_link(F.col("url")).alias("link"), X.link_domain(F.col("url")).alias("domain"))


@query(f"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(replace(coalesce(text, ''), '|', ' '), '<[^>]+>', '', 'g'), '{SQL_SPACE}', ' ', 'g'), ' ') || '|' || source) AS hash FROM documents""")
def dedupe_hash(spark, d):
    """X5, over all documents; the SQL takes out tags, entities are decoded in the tests' plain model."""
    return table(spark, d, "documents").select("doc_id", X.dedupe_hash(F.translate("text", "|", " "), F.col("source")).alias("hash"))


@query("SELECT MIN(doc_id) AS doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL GROUP BY text")
def dedupe_first(spark, d):
    """The first document of each digest."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("hash"))
    return S.insert_ignore(docs, docs.limit(0), ["hash"], [F.col("doc_id")])


@query(f"""WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '{SQL_SPACE}', ' ', 'g'), ' ') AS x, text FROM documents)
SELECT doc_id, CASE WHEN nullif(text, '') IS NULL THEN NULL WHEN length(x) > 280 THEN rtrim(substring(x, 1, 279), ' ') || '…' ELSE x END AS excerpt FROM t""")
def excerpt(spark, d):
    """Cut to 280 code points."""
    return table(spark, d, "documents").select("doc_id", X.body_excerpt(F.col("text")).alias("excerpt"))


@query("""SELECT doc_id, len(list_distinct(regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '<[^>]+>', '', 'g')), '[0-9A-Za-z가-힣]{2,}'))) AS n_tokens FROM documents""")
def tokens(spark, d):
    """Number of distinct words, over all documents."""
    return table(spark, d, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query()
def tokens_all(spark, d):
    """X1, X8, on all documents, the words in order; tested against a plain model."""
    return table(spark, d, "documents").select("doc_id", X.tokens(F.col("text")).alias("tokens"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_field(spark, d):
    """X18."""
    return table(spark, d, "events").select("event_id", X.json_field(F.col("props"), "k").alias("k"))


@query("SELECT event_id, CAST(ts + INTERVAL 9 HOUR AS DATE) AS business_date FROM events")
def business_day(spark, d):
    """X12."""
    return table(spark, d, "events").select("event_id", V.business_date(F.col("ts")).alias("business_date"))


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def iso_text(spark, d):
    """X13."""
    return table(spark, d, "events").select("event_id", V.iso_utc(F.col("ts")).alias("iso"))


@query()
def html_body(spark, d):
    """Not SQL; tested against a plain parser."""
    return table(spark, d, "pages").select("page_id", body_text("html").alias("body"))


@query("""SELECT COALESCE(o.o_orderkey, n.o_orderkey) AS o_orderkey, COALESCE(o.o_custkey, n.o_custkey) AS o_custkey,
COALESCE(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, COALESCE(n.o_totalprice, o.o_totalprice) AS o_totalprice
FROM (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders) o FULL JOIN
(SELECT CASE WHEN o_orderstatus = 'P' THEN o_orderkey ELSE -o_orderkey END AS o_orderkey, o_custkey + 1 AS o_custkey, 'X' AS o_orderstatus, o_totalprice * 2 AS o_totalprice
 FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey > 0) n ON o.o_orderkey = n.o_orderkey""")
def upsert_merge(spark, d):
    """Changed and new rows over a table; a known key keeps o_custkey."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderstatus <> 'F' and o_orderkey > 0").select(
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey")).otherwise(-F.col("o_orderkey")).alias("o_orderkey"),
        (F.col("o_custkey") + 1).alias("o_custkey"), F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"),
    )
    return S.upsert(o, new, ["o_orderkey"], keep=["o_custkey"])


@query("""SELECT o.o_orderkey, COALESCE(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, o.o_totalprice FROM orders o
LEFT JOIN (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'U' END AS o_orderstatus FROM orders WHERE o_orderstatus = 'O') n ON n.o_orderkey = o.o_orderkey""")
def patch_update(spark, d):
    """Null keeps."""
    o = table(spark, d, "orders")
    changes = o.where("o_orderstatus = 'O'").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "U").alias("o_orderstatus"))
    return S.patch(o.select("o_orderkey", "o_orderstatus", "o_totalprice"), changes, "o_orderkey")


@query("""SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)""")
def delete_by_ids(spark, d):
    """What is left after a delete and its cascade."""
    gone = table(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("id"))
    return S.delete(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), gone, "s_nationkey").drop("s_nationkey")


@query("""SELECT s_suppkey, CASE WHEN n_regionkey = 2 THEN NULL ELSE s_nationkey END AS s_nationkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")
def set_null(spark, d):
    """References to deleted rows become null."""
    gone = table(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("id"))
    return S.set_null(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), gone, "s_nationkey")


@query("SELECT 1000 + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id, o_orderkey FROM orders")
def allocate_ids(spark, d):
    """New rows numbered on from the greatest id."""
    existing = spark.createDataFrame([(1000,)], "id long")
    return S.with_ids(table(spark, d, "orders").select("o_orderdate", "o_orderkey"), existing, ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""SELECT 'dup' AS rule, CAST(o_custkey AS VARCHAR) AS detail FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey HAVING COUNT(*) > 1
UNION ALL SELECT 'orphan', CAST(l_suppkey AS VARCHAR) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
UNION ALL SELECT 'enum', o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')""")
def constraint_violations(spark, d):
    """V1 to V12, by their three shapes."""
    orders, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    out = validators.repeated(orders.where("o_orderstatus = 'P'"), "dup", ["o_custkey"])
    out = out.unionByName(validators.orphans(line, "orphan", "l_suppkey", table(spark, d, "supplier").where("s_acctbal > 0"), "s_suppkey"))
    return out.unionByName(validators.outside_enum(orders, "enum", "o_orderpriority", PRIORITIES[:2]))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR o_custkey % 7 = 0 THEN 'FAILED' WHEN o_orderpriority = '1-URGENT' OR o_totalprice > 100000 THEN 'PARTIAL'
ELSE 'SUCCESS' END AS status FROM orders""")
def status_policy_chain(spark, d):
    """B10."""
    o = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "E").alias("error_code"), F.lit("").alias("error_message"),
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("page_id"), F.lit(None).cast("string").alias("partial_message"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("partial_reasons"), F.lit(0).alias("warnings"),
        F.when(F.col("o_totalprice") > 100000, 1).otherwise(0).alias("fallback_count"),
    )
    return status_policy(o).select("o_orderkey", "status")


@query("""SELECT o_custkey, COUNT(*) AS fetched, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS candidates,
COUNT(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS inserted FROM orders GROUP BY o_custkey""")
def keyword_counts(spark, d):
    """A8."""
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "keyword_id")
    got = A.keyword_counts(o.withColumn("matched", F.col("o_orderstatus") == "O"), o.where("o_orderpriority = '1-URGENT'"))
    return got.withColumnRenamed("keyword_id", "o_custkey")


GREEDY_SQL = """WITH RECURSIVE t AS (
  SELECT CAST(user_id % 50 AS BIGINT) AS market, CAST(ts AS DATE) AS day, event_id, row_number() OVER (PARTITION BY user_id % 50, CAST(ts AS DATE) ORDER BY ts, event_id) AS n,
    ['u' || (user_id % 3), event_type, 'd' || extract('day' FROM ts), 'h' || extract('hour' FROM ts)] AS words FROM events
), g AS (
  SELECT market, day, 1 AS n, [{'words': words, 'ids': [event_id]}] AS groups FROM t WHERE n = 1
  UNION ALL
  SELECT t.market, t.day, t.n, CASE WHEN hit IS NULL THEN list_append(g.groups, {'words': t.words, 'ids': [t.event_id]})
    ELSE list_transform(g.groups, lambda x, k: CASE WHEN k = hit THEN {'words': list_distinct(list_concat(x.words, t.words)), 'ids': list_append(x.ids, t.event_id)} ELSE x END) END
  FROM g JOIN t ON t.market = g.market AND t.day = g.day AND t.n = g.n + 1,
  LATERAL (SELECT list_position(list_transform(g.groups, lambda x: len(list_intersect(x.words, t.words)) >= 2), true) AS hit)
), last AS (SELECT market, day, arg_max(groups, n) AS groups FROM g GROUP BY market, day),
flat AS (SELECT market, day, unnest(groups) AS grp, generate_subscripts(groups, 1) AS group_no FROM last)
SELECT market, day, CAST(group_no AS INT) AS group_no, unnest(grp.ids) AS event_id FROM flat"""


@query(GREEDY_SQL)
def greedy_cluster(spark, d):
    """G1: first-match greedy groups within each market's day, over all events."""
    e = table(spark, d, "events").select(
        F.pmod("user_id", F.lit(50)).alias("market"), F.to_date("ts").alias("day"), "event_id", "ts",
        F.array(F.concat(F.lit("u"), F.pmod("user_id", F.lit(3))), "event_type", F.concat(F.lit("d"), F.dayofmonth("ts")), F.concat(F.lit("h"), F.hour("ts"))).alias("words"),
    )
    return G.greedy_groups(e, ["market", "day"], ["ts", "event_id"], "words", "event_id")


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, p_name || '/' || p_type || '|' || p_brand AS title FROM lineitem JOIN part ON l_partkey = p_partkey),
g AS (SELECT l_orderkey, string_split(string_agg(translate(title, '/|', '  '), ' ' ORDER BY l_linenumber, title), ' ') AS s FROM w GROUP BY l_orderkey),
u AS (SELECT l_orderkey, unnest(s) AS t, generate_subscripts(s, 1) AS k FROM g), f AS (SELECT l_orderkey, t, min(k) AS k FROM u WHERE length(t) >= 2 GROUP BY l_orderkey, t),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY k) AS r FROM f) SELECT l_orderkey, string_agg(t, ',' ORDER BY k) AS tags FROM n WHERE r <= 5 GROUP BY l_orderkey""")
def tag_counts(spark, d):
    """The first five distinct words of the titles of an order's lines, in order of line."""
    lines, parts = table(spark, d, "lineitem"), table(spark, d, "part")
    title = F.concat("p_name", F.lit("/"), "p_type", F.lit("|"), "p_brand")
    titles = lines.join(parts, lines.l_partkey == parts.p_partkey).select("l_orderkey", "l_linenumber", title.alias("title"))
    grouped = A.grouped_lists(titles, ["l_orderkey"], ["l_linenumber"], "title", "titles")
    return grouped.select("l_orderkey", F.array_join(X.tags(F.col("titles")), ",").alias("tags"))


@query()
def first_tags(spark, d):
    """A source's first five distinct words over its texts in order of doc_id; not SQL: tested against a plain model.

    A source's first five are among the first five of the texts they first stand in.
    """
    own = table(spark, d, "documents").select("source", "doc_id", F.posexplode(X.tags(F.array("text"))).alias("place", "tag"))
    first = own.groupBy("source", "tag").agg(F.min(F.struct("doc_id", "place")).alias("at"))
    five = R.ranked(first, ["source"], [F.col("at"), F.col("tag")], "n").where("n <= 5")
    return A.grouped_lists(five, ["source"], ["n"], "tag", "tags")


@query("""SELECT event_type, COUNT(*) AS n, CAST(SUM(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS fallback_count FROM events GROUP BY event_type""")
def fallback_counts(spark, d):
    """Rows and flags of each group."""
    return A.fallback_counts(table(spark, d, "events").withColumn("fallback_used", F.col("value") > 50), ["event_type"])


@query("""SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN 0 ELSE GREATEST(CAST(ROUND(epoch_us(o_orderdate + INTERVAL 1500 MILLISECOND) / 1000000.0 - epoch_us(o_orderdate) / 1000000.0) AS INT), 0) END AS seconds FROM orders""")
def rounded_duration(spark, d):
    """Rounded seconds, not below 0."""
    end = F.col("o_orderdate") + F.expr("INTERVAL 1500 MILLISECONDS")
    return table(spark, d, "orders").select("o_orderkey", V.whole_seconds(end, F.col("o_orderdate")).alias("seconds"))


# the queries over the briefing's shapes register themselves
from briefloom.plans import briefing_queries, store_queries  # noqa: E402, F401
