"""Expressions against plain Python models, row by row."""

import datetime as dt
import hashlib
import html
import re
from decimal import ROUND_HALF_EVEN, Decimal, localcontext
from urllib.parse import urlsplit, urlunsplit

from pyspark.sql import functions as F

from briefloom.functions import text as X
from briefloom.functions import values as V
from briefloom.functions.html import body_text_of, unescape

TEXTS = [
    None, "", " a  b ", "<b>Samsung</b> &amp; &lt;b&gt; up", "  wide　space \x1c end", "AI/chips | <i>AI</i> 반도체 반도체 a", "x" * 300,
    "&amp;amp; &quot;q&quot; &#39;s&#39;", "가나다 가나다 AB ab 1 22", "word " * 80, "😀" * 250, "<p", "a < b > c",
]
LINKS = [
    None, "", "HTTPS://News.Example.com/A/b//?Q=1#frag", " http://x.com/ ", "http://x.com", "//host/path/", "mailto:a@b", "/only/path/", "http://한글.kr/기사?a=b c",
    "http://u:P@Host:80/p?x=/y/", "http://x.com/a\tb/\n", "ftp://h/;p?", "no scheme here", "?q=1", "http://x.com/a#",
]


def strip_html(v):
    return html.unescape(re.sub(r"<[^>]+>", "", v)).strip() if v else ""


def spaces(v):
    return re.sub(r"\s+", " ", v).strip() if v else ""


def title(v):
    return spaces(strip_html(v))


def link(v):
    if not v:
        return ""
    p = urlsplit(v.strip())
    return urlunsplit((p.scheme.lower(), p.netloc.lower(), p.path.rstrip("/"), p.query, ""))


def cut(v, n):
    return v if len(v) <= n else v[: n - 1].rstrip() + "…"


def distinct_tokens(v):
    return list(dict.fromkeys(re.findall(r"[0-9A-Za-z가-힣]{2,}", title(v).lower())))


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.out for r in df.select("k", make(F.col("v")).alias("out")).orderBy("k").collect()]


def test_text(spark):
    assert column(spark, TEXTS, X.normalize_whitespace) == [spaces(t) for t in TEXTS]
    assert column(spark, TEXTS, X.strip_html) == [strip_html(t) for t in TEXTS]
    assert column(spark, TEXTS, X.normalize_title) == [title(t) for t in TEXTS]
    assert column(spark, TEXTS, X.excerpt) == [cut(title(t), 240) for t in TEXTS]
    assert column(spark, TEXTS, X.body_excerpt) == [cut(spaces(t), 280) if t else None for t in TEXTS]
    assert column(spark, TEXTS, X.tokens) == [distinct_tokens(t) for t in TEXTS]


def test_entities_equal_the_standard_decoder(spark):
    from html.entities import html5

    names = [f"x&{n} {n}&{n}b;&{n}=&{n}1" for n in html5] + [f"&{n[:-1]}" for n in html5 if n.endswith(";")]
    numbers = [*range(0x200), *range(0xD7F0, 0xE010), *range(0xFDC0, 0xFE00), *range(0xFFF0, 0x10010), 0x1FFFE, 0x1FFFF, 0x10FFFE, 0x10FFFF, 0x110000, 10**12]
    refs = [f"a&#{n};b&#{n}c&#x{n:x};&#X{n:X}g" for n in numbers]
    odd = ["&", "&&", "&&&amp;&", "&#", "&#;", "&#x", "&#xg;", "&#00000000000038;", "&#x0000000026", "& amp;", "&amp;lt;", "&ampamp;", "&notit;", "&notin;", "&no", "&a" * 40, "&" + "a" * 40, "&é;", "&lt&gt", "a &unknown; b",
           "&AMP", "&Aacute", "&aacutex", None, "", "\ud7ff&#55296;"]
    every = names + refs + odd
    assert column(spark, every, unescape) == [t if t is None else html.unescape(t) for t in every]


def test_long_runs_take_linear_time(spark):
    """A megabyte of blanks, brackets, ampersands and the like, at the ends and within."""
    import time

    parts = [" ", "\u3000", "\n", "<", ">", "<>", "<a", "&", "&amp;", "&#", "&a;", "`", "/", "Mon ", "a,"]
    runs = lambda n: [f"{a}{p * (n // len(p))}{b}" for p in parts for a, b in (("", ""), ("x", "y"))]
    assert column(spark, runs(600), X.strip_html) == [strip_html(t) for t in runs(600)]
    assert column(spark, runs(600), X.normalize_title) == [title(t) for t in runs(600)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(runs(1_000_000))], "k int, v string").repartition(4).cache()
    df.count()
    answer = lambda c: X.model_answer(c, "a int")
    for make in (X.strip_html, X.normalize_title, X.tokens, X.canonicalize_link, X.body_excerpt, V.parse_pub_date, answer):
        began = time.perf_counter()
        df.select(make(F.col("v")).alias("out")).write.format("noop").mode("overwrite").save()
        assert time.perf_counter() - began < 40, make


def test_titles_and_hashes_run_no_python(spark):
    df = spark.createDataFrame([("a", "b")], "t string, l string")
    for c in (X.normalize_title(F.col("t")), X.dedupe_hash(F.col("t"), F.col("l")), X.tokens(F.col("t")), X.excerpt(F.col("t"))):
        plan = df.select(c)._jdf.queryExecution().executedPlan()
        assert not re.search("EvalPython|MapIn", plan.nodeName() + plan.children().mkString())


def test_links(spark):
    assert column(spark, LINKS, X.canonicalize_link) == [link(t) for t in LINKS]
    assert column(spark, LINKS, X.link_domain) == [urlsplit((t or "").strip()).netloc or None for t in LINKS]


def test_dedupe_hash(spark):
    got = column(spark, TEXTS, lambda c: X.dedupe_hash(c, F.lit("HTTP://A.b/c/")))
    assert got == [hashlib.sha256(f"{title(t)}|http://a.b/c".encode()).hexdigest() for t in TEXTS]


def test_tags_keep_case_and_order(spark):
    df = spark.createDataFrame([(["AI/chip up", "ai | AI x", None, "chip fund tax rate"],)], "t array<string>")
    assert df.select(X.tags(F.col("t"))).first()[0][:5] == ["AI", "chip", "up", "ai", "fund"]


def test_json(spark):
    assert column(spark, ['{"description":"d"}', "[]", "x", None], lambda c: X.json_field(c, "description")) == ["d", None, None, None]
    assert column(spark, ['["a","b"]', None], X.json_texts) == [["a", "b"], []]
    got = column(spark, ['```json\n{"a":1}\n```', '{"a":2}', "[1]", "no", None], lambda c: X.model_answer(c, "a int"))
    assert [g and g.a for g in got] == [1, 2, None, None, None]
    raw = ['{"a":', '{"a":1} x', '{"a":1},{"a":2}', '``` {"a":3}```', '```\n{"b":1}\n```', "  {\"a\":4} ", "{}", "```json\n[]```", ""]
    got = column(spark, raw, lambda c: X.model_answer(c, "a int"))
    assert [g if g is None else g.a for g in got] == [None, None, None, 3, None, 4, None, None, None] and got[4] is not None and got[6] is not None


def test_dates(spark):
    raw = ["Tue, 17 Mar 2026 09:01:02 +0900", "17 Mar 2026 00:00:00 GMT", "Tue, 17 Mar 2026 09:01:02", "nonsense", None]
    got = column(spark, raw, lambda c: V.iso_utc(V.parse_pub_date(c)))
    assert got == ["2026-03-17T00:01:02Z", "2026-03-17T00:00:00Z", None, None, None]
    from email.utils import parsedate_to_datetime

    raw = [
        "Tue, 17 Mar 2026 09:01:02 EST", "Tue,17 Mar 2026 9:00:00 +0900", "17 Mar 26 09:01 PDT", "Tue, 17 March 1999 09:01:02 -0330", "17 Mar 75 01:02:03 Z",
        "Tue, 17 Mar 2026 09:01:02 -0000", "Tue, 31 Feb 2026 09:01:02 +0900", "Tue, 17 Mar 2026 25:01:02 +0900", "Tue, 17 Mar 2026 09:01:60 +0900", "tue, 1 dec 2026 00:00:00 gmt", "", "x",
    ]

    def plain(v):
        try:
            d = parsedate_to_datetime(v)
        except (TypeError, ValueError, IndexError):
            return None
        return d if d.tzinfo else None

    got = column(spark, raw, lambda c: F.struct(V.iso_utc(V.parse_pub_date(c)).alias("at"), V.pub_iso(c).alias("iso")))
    for v, g in zip(raw, got):
        want = plain(v)
        assert (g.at, g.iso) == ((None, None) if want is None else (want.astimezone(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), want.isoformat())), v
    late = dt.datetime(2026, 3, 16, 15, 0)
    assert column(spark, [late, late - dt.timedelta(seconds=1)], V.business_date, "timestamp_ntz") == [dt.date(2026, 3, 17), dt.date(2026, 3, 16)]


def test_change_is_half_even(spark):
    rows = [
        ("1.00005", "0"), ("100.00015", "100"), ("3", "7"), ("2", "-8"), ("1.000149999999", "0"), ("-1.00005", "1"), ("1.000001500001", "1"), ("1.0000015", "1"),
        ("1.0000025", "1"), ("5021.123456789012", "4999.98765432101"), ("0.9999985", "1"), ("-2", "-1.99999")
    ]
    df = spark.createDataFrame(rows, "a string, b string").select(F.col("a").cast("decimal(28,14)").alias("a"), F.col("b").cast("decimal(28,14)").alias("b"))
    q = lambda d: d.quantize(Decimal("0.0001"), ROUND_HALF_EVEN)
    got = df.select(V.quantized(F.col("a")), *V.change(F.col("a"), F.col("b"))).collect()
    for (a, b), r in zip(rows, got):
        a, b = Decimal(a), Decimal(b)
        assert tuple(r) == (q(a), q(a - b), q((a - b) / b * 100) if b else Decimal("0.0000"))


def test_body_text():
    page = "<html><head><meta name='description' content='short &amp; sweet'></head><body>{}</body></html>"
    assert body_text_of(page.format("<div>x</div><article> A <script>no()</script><p>B<br>C</p></article><main>M</main>")) == "A B C"
    assert body_text_of(page.format("<div id=dic_area>in <b>here</b></div>")) == "in here"
    assert body_text_of(page.format("<div class='z article_body'>one<div>two</div></div>three")) == "one two"
    assert body_text_of(page.format("nothing marked")) == "short & sweet"
    assert body_text_of("<p>plain</p>") is None and body_text_of("") is None and body_text_of(None) is None


def test_change_percent_has_room_for_any_change(spark):
    """A close of 560 on one of 0.01 is a change of 5,599,900 percent, more than decimal(10,4) holds."""
    rows = [("560.00", "0.01"), ("0.01", "560.00"), ("999999999999.99999999", "0.00000001"), ("-999999999999.99999999", "0.00000003"), ("0.00000001", "999999999999.99999999"), ("1.00015", "-1.0"), ("5", "0")]
    df = spark.createDataFrame([(k, *map(Decimal, r)) for k, r in enumerate(rows)], "k int, close decimal(20,8), before decimal(20,8)")
    got = {r.k: r.p for r in df.select("k", V.change(F.col("close"), F.col("before"))[1].alias("p")).collect()}
    with localcontext() as c:
        c.prec = 80
        for k, (close, before) in enumerate(map(lambda r: map(Decimal, r), rows)):
            assert got[k] == ((close - before) * 100 / before if before else Decimal(0)).quantize(Decimal("0.0001"), ROUND_HALF_EVEN)
