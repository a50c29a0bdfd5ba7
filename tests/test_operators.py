"""Operators on small tables made for their hard cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from briefloom.operators import aggregates as A
from briefloom.operators import grouping as G
from briefloom.operators import joins as J
from briefloom.operators import lookup as L
from briefloom.operators import ranking as R
from briefloom.operators import validators
from briefloom.sources import tables as S

DAY = dt.date(2026, 3, 17)


def test_market_sort_and_null_dates(spark):
    rows = [(1, "KR", None), (2, "US", None), (3, "US", dt.datetime(2026, 3, 17, 1)), (4, "KR", dt.datetime(2026, 3, 17, 2)), (5, "US", dt.datetime(2026, 3, 17, 1))]
    df = spark.createDataFrame([(*r, DAY) for r in rows], "id long, market_type string, published_at timestamp, business_date date")
    assert [r.id for r in L.list_articles(df, DAY).collect()] == [3, 5, 2, 4, 1]
    assert [r.id for r in L.list_articles(df, DAY, "KR").collect()] == [4, 1]


def test_filter_comes_before_latest_version(spark):
    rows = [(1, DAY, 1, "READY"), (2, DAY, 2, "FAILED"), (3, DAY - dt.timedelta(1), 1, "READY"), (4, DAY, 1, "READY")]
    pages = spark.createDataFrame(rows, "id long, business_date date, version_no int, status string")
    ready = L.date_status_filter("business_date", None, DAY, "READY")
    assert [r.id for r in R.latest_versions(pages, ready).collect()] == [4, 3]
    assert A.distinct_days(pages, ready).first()[0] == 2
    assert R.latest_page(pages).first().id == 2
    assert R.page_of_day(pages, DAY, 1).count() == 1 and R.page_of_day(pages, DAY, 9).isEmpty()


def test_pagination():
    assert R.pagination(0, 1000) == (1, 100, 0) and R.pagination(3, 20) == (3, 20, 40) and R.pagination(2, 0) == (2, 1, 1)


def test_status_summary_of_nothing_and_halves(spark):
    jobs = spark.createDataFrame([("SUCCESS", 1), ("RUNNING", 2), ("FAILED", None)], "status string, duration_seconds int")
    assert tuple(A.status_summary(jobs).first()) == (3, 1, 0, 1, 2)
    assert tuple(A.status_summary(jobs.limit(0)).first()) == (0, 0, 0, 0, 0)
    assert A.next_number(jobs.limit(0), "duration_seconds").first()[0] == 1


def test_request_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, t string")
    assert [r.t for r in L.in_request_order(df, [3, 9, 1, 3]).collect()] == ["c", "a", "c"]


def test_uid(spark):
    df = spark.createDataFrame([("0a9b1c2d-0000-4000-8000-000000000001",)], "cluster_uid string")
    assert L.by_uid(df, "0A9B1C2D-0000-4000-8000-000000000001").count() == 1
    with pytest.raises(ValueError):
        L.by_uid(df, "x' or 1=1")


def test_links_put_undated_first(spark):
    c = spark.createDataFrame([(1, "u", "t", "US", 1)], "id long, cluster_uid string, title string, market_type string, cluster_rank int")
    m = spark.createDataFrame([(1, 10, 1), (1, 11, 1), (1, 12, 1)], "cluster_id long, processed_article_id long, article_rank int")
    p = spark.createDataFrame(
        [(10, "a", dt.datetime(2026, 1, 1)), (11, "b", None), (12, "c", dt.datetime(2026, 1, 2))], "id long, canonical_title string, published_at timestamp"
    ).withColumns({x: F.lit("") for x in ("publisher_name", "origin_link", "naver_link")})
    assert [r.processed_article_id for r in J.cluster_article_links(c, m, p).collect()] == [11, 12, 10]


def test_last_wins_and_null_keys(spark):
    df = spark.createDataFrame([("a", None, 1, "x"), ("a", None, 2, "y"), ("b", 5, 1, "z")], "t string, k int, n int, v string")
    last = J.last_of(df, ["t", "k"], ["n"])
    got = J.null_safe_lookup(df.select("t", "k").distinct(), last, ["t", "k"], {"value": "v"})
    assert {(r.t, r.k, r.value) for r in got.collect()} == {("a", None, "y"), ("b", 5, "z")}


def test_take_while(spark):
    df = spark.createDataFrame([(1, 0, False), (1, 1, True), (1, 2, False), (2, 0, None), (2, 1, False)], "k int, p int, s boolean")
    assert {(r.k, r.p) for r in R.take_while(df, ["k"], "p", F.col("s")).collect()} == {(1, 0), (2, 0), (2, 1)}


def greedy(rows):
    groups = []
    for i, words in rows:
        hit = next((g for g in groups if words and len(set(words) & g[0]) >= 2), None)
        if hit:
            hit[0].update(words)
            hit[1].append(i)
        else:
            groups.append((set(words), [i]))
    return [g[1] for g in groups]


def test_greedy_groups_follow_the_first_match(spark):
    rows = [(1, ["a", "b"]), (2, ["c", "d"]), (3, ["a", "b", "c", "d"]), (4, ["c", "d", "e", "f"]), (5, []), (6, ["e", "f"]), (7, ["a", "z"]), (8, [])]
    df = spark.createDataFrame([("m", i, w) for i, w in rows] + [("n", 100 + i, w) for i, w in reversed(rows)], "m string, id long, w array<string>")
    got = {}
    for r in G.greedy_groups(df, ["m"], ["id"], "w", "id").collect():
        got.setdefault((r.m, r.group_no), []).append(r.id)
    want = greedy(rows)
    assert [sorted(got["m", k + 1]) for k in range(len(want))] == want
    assert [[i - 100 for i in sorted(got["n", k + 1])] for k in range(len(want))] == want


def test_described_group(spark):
    t = dt.datetime(2026, 3, 17)
    rows = [(1, t, "Old/one x", "s1", "e1"), (2, None, "Undated", None, "e2"), (3, t + dt.timedelta(1), "<b>New</b> one", "", "e3"), (4, t, "Tie | up", "s4", None)]
    df = spark.createDataFrame([("US", 1, *r) for r in rows], "market_type string, group_no int, id long, published_at timestamp, canonical_title string, source_summary string, article_body_excerpt string")
    g = G.described(df, ["market_type", "group_no"])
    r = g.first()
    assert r.article_ids == [3, 4, 1, 2] and r.representative_article_id == 3 and r.article_count == 4
    assert (r.title, r.summary_short, r.summary_long) == ("New one", "e3", "s4 / s1")
    assert r.analysis_paragraphs_json == ["e3", "s4", "s1"] and r.tags_json == ["<b>New<", "b>", "one", "Tie", "up"]
    answers = spark.createDataFrame([("US", 1, "T", "", None, [], ["p"], 9)], "market_type string, group_no int, title string, summary_short string, summary_long string, tags array<string>, analysis_paragraphs array<string>, representative_article_index int")
    answers = answers.select("market_type", "group_no", F.struct(*answers.columns[2:]).alias("a"), F.lit(None).cast("string").alias("error"))
    a = G.answered(g, answers, ["market_type", "group_no"]).first()
    assert (a.title, a.summary_short, a.analysis_paragraphs_json, a.representative_article_id, a.fallback_used) == ("T", "e3", ["p"], 3, False)
    assert G.answered(g, answers.limit(0), ["market_type", "group_no"]).first().fallback_used


def test_names_are_validated():
    assert S.qualified("t_1", "stock") == "stock.t_1"
    for bad in ("a;b", "1a", "a b", "", 'a"'):
        with pytest.raises(ValueError):
            S.qualified(bad)
        with pytest.raises(ValueError):
            S.qualified("t", bad)


def test_insert_ignore_and_ids(spark):
    have = spark.createDataFrame([(5, "a", 1)], "id long, k string, v int")
    new = spark.createDataFrame([("a", 9), ("b", 2), ("b", 1), ("c", 3)], "k string, v int")
    add, ids = S.get_or_create(new, have, ["k"], ["v"])
    assert {tuple(r) for r in add.select("id", "k", "v").collect()} == {(6, "b", 1), (7, "c", 3)}
    assert {(r.k, r.id) for r in ids.collect()} == {("a", 5), ("b", 6), ("c", 7)}


def test_upsert_keeps_and_patch_coalesces(spark):
    have = spark.createDataFrame([(1, "a", 1, "x"), (2, "b", 2, "y")], "id long, k string, v int, created_at string")
    new = spark.createDataFrame([(7, "b", None, "new"), (8, "c", 3, "new")], "id long, k string, v int, created_at string")
    got = {tuple(r) for r in S.upsert(have, new, ["k"]).collect()}
    assert got == {(1, "a", 1, "x"), (2, "b", None, "y"), (8, "c", 3, "new")}
    changes = spark.createDataFrame([(1, None, ""), (2, 5, None)], "id long, v int, created_at string")
    assert {tuple(r) for r in S.patch(have, changes).collect()} == {(1, "a", 1, ""), (2, "b", 5, "y")}


def test_delete_cascades(spark):
    gone = spark.createDataFrame([(1,)], "id long")
    kids = spark.createDataFrame([(1, 10), (2, 20), (None, 30)], "cluster_id long, n int")
    assert sorted(r.n for r in S.delete(kids, gone, "cluster_id").collect()) == [20, 30]
    assert sorted((r.n, r.cluster_id) for r in S.set_null(kids, gone, "cluster_id").collect() if r.cluster_id) == [(20, 2)]


def test_violations(spark):
    c = spark.createDataFrame([(1, "u", DAY, "US", 1, 10), (2, "v", DAY, "US", 1, 11), (3, "w", DAY, "XX", 2, 12)], "id long, cluster_uid string, business_date date, market_type string, cluster_rank int, representative_article_id long")
    m = spark.createDataFrame([(1, 10, 1), (1, 13, 1), (9, 12, 1)], "cluster_id long, processed_article_id long, article_rank int")
    got = {(r.rule, r.detail) for r in validators.violations({"news_cluster": c, "news_cluster_article": m}).collect()}
    assert got == {
        ("cluster rank", "2026-03-17|US|1"), ("representative is a member", "2"), ("representative is a member", "3"),
        ("article rank", "1|1"), ("member cluster", "9"), ("news_cluster market_type", "XX"),
    }


def test_violations_read_each_table_once(spark, small):
    """Planted rows of every kind of rule, keys with bars, nulls; and the plan of all rules."""
    from briefloom.operators.validators import Belongs, Holds, Unique
    from briefloom.plans.briefing_queries import VALIDATED
    from briefloom.plans.shapes import Shapes

    rules = (Unique("u", "a", ("x", "y")), Unique("w", "a", ("x",), "y = 'q'"), Belongs("b", "a", ("x",), "p", ("id",)), Holds("h", "a", "y <> 'bad'", "x"))
    a = spark.createDataFrame([("1|2", "3"), ("1", "2|3"), ("1", "2|3"), ("1", "q"), ("1", "q"), ("7", "bad"), ("7", "bad"), (None, "bad"), ("8", None)], "x string, y string")
    p = spark.createDataFrame([("1",), ("8",), (None,)], "id string")
    got = sorted(map(tuple, validators.violations({"a": a, "p": p}, rules).collect()))
    assert got == [
        ("b", "1|2", 1), ("b", "7", 2), ("h", "", 1), ("h", "7", 2), ("u", "1|2\\|3", 2), ("u", "1|q", 2), ("u", "7|bad", 2), ("w", "1", 2)
    ]
    t = Shapes(spark, small)
    plan = validators.violations({n: t.read(n) for n in VALIDATED})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == len(VALIDATED) and plan.count("hashpartitioning(rule") == 1
    with pytest.raises(ValueError):
        validators.violations({})


@pytest.mark.parametrize("most", [5, 40, 10_000])
def test_deep_pages_equal_a_sort(spark, most):
    """Any page, through ties, nulls, one frequent value, both directions."""
    import random

    r = random.Random(most)
    rows = [(r.choice([None, 1.5, 2.5, 2.5, 2.5, 2.5, r.random()]), r.choice([dt.date(2026, 1, 1 + r.randrange(5)), None]), k) for k in range(300)]
    df = spark.createDataFrame(rows, "a double, b date, k long")
    for up_a, up_b in ((True, False), (False, True)):
        order = [("a", up_a), ("b", up_b), ("k", True)]
        want = [x.k for x in df.orderBy(*R._in_order(order)).collect()]
        for page, size in ((1, 7), (13, 11), (30, 10), (31, 10), (150, 2)):
            assert [x.k for x in R.deep_page(df, order, page, size, most).collect()] == want[(page - 1) * size : page * size], (page, size)
    assert R.deep_page(df.limit(0), [("k", True)], 3, 5).count() == 0


def test_a_deep_page_sorts_its_range_only(spark):
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).alias("x"))
    got = R.deep_page(df, [("x", True)], 1500, 100, 20_000)
    assert [r.x for r in got.limit(3).collect()] == [r.x for r in df.orderBy("x").offset(149_900).limit(3).collect()]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and int(plan.split("Offset ")[1].split()[0].rstrip(",")) < 20_000


def test_violations_deal_their_records_to_the_tasks_asked_for(spark, small):
    """Tasks follow the input; keys that are numbers are dealt as numbers; a rule asked for alone makes no other's records."""
    from briefloom.plans.shapes import SHARE, Shapes

    t = Shapes(spark, small, dealt=True)
    t.sizes = {"lineitem": 50 * SHARE, "part": 3}
    names = ("news_cluster", "news_cluster_article")
    assert t.tasks(*names) == 51 and Shapes(spark, small).tasks(*names) == 4
    rules = [r for r in validators.RULES if r.rule == "representative is a member"]
    got = validators.violations({n: t.read(n) for n in names}, rules, t.tasks(*names))
    plan = got._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(dealt) == 2 and all(n in " ".join(dealt) for n in (", 51)", ", 50)")) and "as string)" not in " ".join(x for x in plan.splitlines() if "Generate" in x)
    every = validators.violations({n: Shapes(spark, small).read(n) for n in names}).where("rule = 'representative is a member'")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.collect())) != []


def test_violations_of_numbers_and_texts(spark):
    """Keys of one or two numbers, of a number and a text, of a long and the text of it, nulls, rules of conditions alone."""
    from briefloom.operators.validators import Belongs, Holds, Unique

    rules = (
        Unique("two", "a", ("x", "y")), Unique("one", "a", ("x",), "y > 1"), Unique("mixed", "a", ("x", "z")), Belongs("pair", "a", ("x", "y"), "p", ("i", "j")),
        Belongs("text", "a", ("x",), "s", ("i",)), Belongs("int", "a", ("y",), "p", ("j",)), Holds("h", "o", "v > 0", "w"),
    )
    a = spark.createDataFrame([(1, 1, "q"), (1, 1, "q"), (1, 2, "q|"), (1, 3, None), (None, 3, "q"), (2, None, "q"), (2**40, 2, "q")], "x long, y int, z string")
    p = spark.createDataFrame([(1, 1), (1, 2), (None, 3)], "i int, j long")
    s = spark.createDataFrame([("1",), ("x",)], "i string")
    o = spark.createDataFrame([(0, "w"), (-1, "w"), (1, "w"), (None, "w"), (-2, None), (-2, None)], "v int, w string")
    got = sorted(map(tuple, validators.violations({"a": a, "p": p, "s": s, "o": o}, rules).collect()))
    big = str(2**40)
    assert got == [
        ("h", "", 2), ("h", "w", 2), ("mixed", "1|q", 2), ("one", "1", 2), ("pair", "1", 1), ("pair", big, 1), ("text", big, 1), ("text", "2", 1), ("two", "1|1", 2)
    ]
