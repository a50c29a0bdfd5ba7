"""Integrity rules as a DataFrame of what breaks them: (rule, detail, n_rows).

Every table is read once: a row gives a record for each rule of its table (its key, a key it
refers to, a key it offers to others, or a condition it fails), and one aggregation over the
records of all tables, by rule and key, decides.  Records hold numbers where keys are numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.schemas import ENUMS

#: Types of keys that are compared as numbers.
WHOLE = ("tinyint", "smallint", "int", "bigint")


@dataclass(frozen=True)
class Unique:
    """No two rows with equal ``keys``, among those for which ``when`` holds; null keys don't count."""

    rule: str
    table: str
    keys: tuple
    when: str | None = None


@dataclass(frozen=True)
class Belongs:
    """Non-null ``keys`` of a row are the ``parent_keys`` of some row of ``parent``; the detail is the first key."""

    rule: str
    table: str
    keys: tuple
    parent: str
    parent_keys: tuple = ("id",)


@dataclass(frozen=True)
class Holds:
    """``condition`` isn't false; ``detail`` names the row."""

    rule: str
    table: str
    condition: str
    detail: str = "id"


def _enum(table: str, column: str, enum: str) -> Holds:
    return Holds(f"{table} {column}", table, f"{column} IN ({', '.join(repr(x) for x in ENUMS[enum])})", column)


COUNTS = "raw_news_count >= 0 AND processed_news_count >= 0 AND cluster_count >= 0"
KEYWORD = "lower(trim(keyword))"
_SHOWN = tuple(f"market_daily_page_{n}" for n in ("market_index", "market_cluster", "article_link"))
RULES: tuple = (
    Unique("one active job a day", "batch_job", ("business_date",), "status IN ('PENDING', 'RUNNING')"),
    Unique("raw key", "news_article_raw", ("provider_name", "provider_article_key")),
    Unique("dedupe hash", "news_article_processed", ("dedupe_hash",)),
    Unique("cluster rank", "news_cluster", ("business_date", "market_type", "cluster_rank")),
    Unique("cluster uid", "news_cluster", ("cluster_uid",)),
    Belongs("representative is a member", "news_cluster", ("id", "representative_article_id"), "news_cluster_article", ("cluster_id", "processed_article_id")),
    Unique("article rank", "news_cluster_article", ("cluster_id", "article_rank")),
    Unique("member", "news_cluster_article", ("cluster_id", "processed_article_id")),
    Unique("page version", "market_daily_page", ("business_date", "version_no")),
    Unique("market order", "market_daily_page_market", ("page_id", "display_order")),
    Unique("page market", "market_daily_page_market", ("page_id", "market_type")),
    *(Unique(f"{n} order", n, ("page_market_id", "display_order")) for n in _SHOWN),
    *(Belongs(f"{n} parent", n, ("page_market_id",), "market_daily_page_market") for n in _SHOWN),
    Unique("keyword", "news_search_keyword", ("provider_name", "market_type", KEYWORD)),
    Holds("keyword not blank", "news_search_keyword", "trim(keyword) <> '' AND trim(provider_name) <> ''"),
    Holds("priority above 0", "news_search_keyword", "priority > 0"),
    Holds("job counts", "batch_job", f"{COUNTS} AND coalesce(duration_seconds >= 0, true)", "job_id"),
    Holds("job times", "batch_job", "ended_at >= started_at", "job_id"),
    Holds("job scope", "batch_job", "market_scope = 'GLOBAL'", "job_id"),
    Holds("page counts", "market_daily_page", f"{COUNTS} AND version_no > 0"),
    Holds("market counts", "market_daily_page_market", f"{COUNTS} AND display_order > 0"),
    Belongs("event job", "batch_job_event", ("batch_job_id",), "batch_job", ("job_id",)),
    Belongs("member cluster", "news_cluster_article", ("cluster_id",), "news_cluster"),
    Belongs("member article", "news_cluster_article", ("processed_article_id",), "news_article_processed"),
    Belongs("market page", "market_daily_page_market", ("page_id",), "market_daily_page"),
    *(
        _enum(*x)
        for x in (
            ("batch_job", "status", "job_status"), ("batch_job", "trigger_type", "trigger_type"), ("batch_job_event", "level", "event_level"),
            ("news_article_raw", "market_type", "market_type"), ("news_cluster", "market_type", "market_type"), ("market_daily_page", "status", "page_status"),
            ("ai_summary", "status", "summary_status"), ("ai_summary", "summary_type", "summary_type"),
        )
    ),
)


# One rule by itself, a row for each row that breaks it: (rule, detail)


def _out(df: DataFrame, rule: str, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))


def repeated(df: DataFrame, rule: str, keys: Sequence[str]) -> DataFrame:
    """Keys that stand on more than one row; null keys don't count."""
    own = df.select(*keys).dropna().groupBy(*keys).count().where("count > 1")
    return _out(own, rule, F.concat_ws("|", *[F.col(c).cast("string") for c in keys]))


def orphans(df: DataFrame, rule: str, key: str, parents: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows whose non-null ``key`` no parent has."""
    return _out(df.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti"), rule, F.col(key))


def broken(df: DataFrame, rule: str, condition: Column, detail: Column) -> DataFrame:
    """Rows for which the condition that must hold is false."""
    return _out(df.where(~F.coalesce(condition, F.lit(True))), rule, detail)


def outside_enum(df: DataFrame, rule: str, column: str, labels: Sequence[str]) -> DataFrame:
    return broken(df, rule, F.col(column).isin(*labels), F.col(column))


# All rules in one pass


def _key(keys: Sequence[str]) -> Column:
    """The keys as one text, joined by bars (a bar within a key gets a backslash); null if one of them is null."""
    parts = [F.replace(F.replace(F.expr(k).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")) if len(keys) > 1 else F.expr(k).cast("string") for k in keys]
    return F.concat(*[p for k, p in enumerate(parts) for p in ([F.lit("|"), p] if k else [p])])


def _numbers(r, t: dict[str, DataFrame]) -> bool:
    """Whether a rule's keys are one or two whole numbers, on both sides; they are compared as such, other keys as text."""
    if isinstance(r, Holds) or len(r.keys) > 2:
        return False
    sides = [(r.table, r.keys), *([(r.parent, r.parent_keys)] if isinstance(r, Belongs) else [])]
    return all(dict(t[n].dtypes).get(k) in WHOLE for n, keys in sides for k in keys)


def records_of(name: str, t: dict[str, DataFrame], rules: Sequence) -> DataFrame | None:
    """(rule, a, b, key, n) of one table's rows, from one scan; None if no rule is about it.

    ``rule`` is the rule's place.  Its keys are the numbers ``a`` and ``b`` or the text ``key``.
    ``n`` rows have, refer to or fail it; 0 where it is offered.
    """
    made, rows, weight = [], t[name], F.lit(1).cast("long")
    null = lambda kind: F.lit(None).cast(kind)

    def record(place: int, keys: Sequence[str], offers: bool = False, when: Column | None = None) -> None:
        if _numbers(rules[place], t):
            a, b = [F.col(k).cast("long") for k in keys] + [null("long")] * (2 - len(keys))
            full, text = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]), null("string")
        else:
            a, b, text = null("long"), null("long"), _key(keys)
            full = text.isNotNull()
        made.append((F.lit(place), a, b, text, F.lit(0).cast("long") if offers else weight, full if when is None else full & F.coalesce(when, F.lit(False))))

    about = [(k, r) for k, r in enumerate(rules) if r.table == name or isinstance(r, Belongs) and r.parent == name]
    if about and all(isinstance(r, Holds) for _, r in about):  # few different rows: counted where they are read
        rows = rows.groupBy(*[F.expr(r.condition).alias(f"c{k}") for k, r in about], *[F.expr(r.detail).cast("string").alias(f"d{k}") for k, r in about]).agg(F.count("*").alias("n"))
        weight, about = F.col("n"), [(k, Holds(r.rule, name, f"c{k}", f"d{k}")) for k, r in about]
    for k, r in about:
        if isinstance(r, Holds):
            made.append((F.lit(k), null("long"), null("long"), F.coalesce(F.expr(r.detail).cast("string"), F.lit("")), weight, F.coalesce(~F.expr(r.condition), F.lit(False))))
            continue
        if r.table == name:
            record(k, r.keys, when=None if not isinstance(r, Unique) or r.when is None else F.expr(r.when))
        if isinstance(r, Belongs) and r.parent == name:
            record(k, r.parent_keys, offers=True)
    if not made:
        return None
    own = F.explode(F.array(*[F.lit(at) for at in range(len(made))])).alias("__at")
    pick = lambda field: reduce(lambda c, x: c.when(F.col("__at") == x[0], x[1]), list(enumerate(m[field] for m in made))[1:], F.when(F.col("__at") == 0, made[0][field]))
    return rows.select("*", own).where(pick(5)).select(
        pick(0).alias("rule"), pick(1).alias("a"), pick(2).alias("b"), pick(3).alias("key"), pick(4).alias("n")
    )


def violations(t: dict[str, DataFrame], rules: Sequence = RULES, tasks: int | None = None) -> DataFrame:
    """What breaks the rules in the tables given by name, and in how many rows; rules whose tables are missing are left out.

    ``tasks`` is the number of tasks that the records are dealt to by rule and key, for tables too
    large for Spark's number of shuffle partitions: a task holds its share of all keys.
    """
    able = [r for r in rules if r.table in t and (not isinstance(r, Belongs) or r.parent in t)]
    parts = [p for p in (records_of(n, t, able) for n in t) if p is not None]
    if not parts:
        raise ValueError("no table to validate")
    keys, records = ["rule", "a", "b", "key"], reduce(DataFrame.unionByName, parts)
    # keys are mostly different: counted once, where they meet
    dealt = records.repartition(*keys) if tasks is None else records.repartition(tasks, *keys)
    seen = dealt.groupBy(*keys).agg(F.sum("n").alias("n"), (F.min("n") == 0).alias("offered"))
    of = lambda *kinds: F.col("rule").isin([k for k, r in enumerate(able) if isinstance(r, kinds)])
    broken_ = (of(Unique) & (F.col("n") > 1)) | (of(Belongs) & (F.col("n") > 0) & ~F.col("offered")) | of(Holds)
    first = F.col("rule").isin([k for k, r in enumerate(able) if isinstance(r, Belongs) and len(r.keys) > 1])
    number = F.when(first, F.col("a").cast("string")).otherwise(F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string")))
    text = F.when(first, F.substring_index("key", "|", 1)).otherwise(F.col("key"))
    return seen.where(broken_).select(
        F.get(F.array(*[F.lit(r.rule) for r in able]), F.col("rule")).alias("rule"), F.when(F.col("key").isNull(), number).otherwise(text).alias("detail"), F.col("n").alias("n_rows")
    )
