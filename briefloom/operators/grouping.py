"""Greedy issue groups, and what describes a group without a language model."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.functions import text as X
from briefloom.operators.joins import nested
from briefloom.operators.ranking import ranked


def greedy_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], tokens: str, id_column: str, least: int = 2) -> DataFrame:
    """Group the rows of each key in order: a row joins the first group with which it shares ``least`` words.

    A group's words are those of all its rows so far; rows that fit none open a group.  Rows come
    back with ``group_no``, 1, 2, ... by first row.  The order matters, so a key (a market's
    day) is read in sequence; rows stream through sorted, and only the groups' words are held.
    """
    kinds = dict(df.dtypes)
    columns = [*keys, "group_no", id_column]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, groups, number = None, {}, 0
        for pdf in batches:
            out = []
            for *key, words in zip(*[pdf[k] for k in keys], pdf["__words"]):
                key = [None if v != v else v for v in key]
                if key != now:  # the next key: words of its groups, from nothing
                    now, groups, number = key, {}, 0
                own = dict.fromkeys(() if words is None else words)
                hits = Counter(g for w in own for g in groups.get(w, ()))
                at = min((g for g, n in hits.items() if n >= least), default=None)
                if at is None:
                    number += 1
                    at = number
                for w in own:
                    groups.setdefault(w, set()).add(at)
                out.append(at)
            yield pdf[[*keys, id_column]].assign(group_no=out)[columns]

    rows = df.select(*keys, id_column, F.col(tokens).alias("__words"), F.struct(*order, id_column).alias("__order"))
    placed = rows.repartition(*keys).sortWithinPartitions(*keys, "__order").drop("__order")
    schema = ", ".join(f"`{c}` {'int' if c == 'group_no' else kinds[c]}" for c in columns)
    return placed.mapInPandas(fold, schema)


def one_group(df: DataFrame, keys: Sequence[str], id_column: str) -> DataFrame:
    """All rows of a key in group 1: what stands in for the grouping where no model is set up."""
    return df.select(*keys, F.lit(1).alias("group_no"), id_column)


def described(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Title, summaries, tags, paragraphs and representative of each group, from its articles alone.

    ``members`` are processed articles with their group; newest first, undated last, then the
    larger id.  ``article_ids`` holds them in that order.  Only ids are gathered for a whole group;
    of texts no more than the three and of words no more than the five that are shown.
    """
    keys = list(keys)
    filled = lambda c: F.nullif(c, F.lit(""))
    newest = [F.col("published_at").desc_nulls_last(), F.col("id").desc()]
    rows = ranked(members.select(*keys, "id", "published_at", "canonical_title", "source_summary", "article_body_excerpt"), keys, newest, "place")

    def first(df: DataFrame, most: int, *fields: Column) -> DataFrame:
        return nested(ranked(df, keys, [F.col("place")], "n").where(F.col("n") <= most), keys, ["place"], fields, "first")

    head = first(rows, 3, F.col("id"), F.col("canonical_title").alias("title"), F.col("source_summary").alias("summary"), F.col("article_body_excerpt").alias("excerpt"))
    long = first(rows.where(filled(F.col("source_summary")).isNotNull()), 3, F.col("source_summary").alias("summary"))
    words = rows.select(*keys, "place", F.posexplode(X.tags(F.array("canonical_title"))).alias("at", "word"))
    words = words.groupBy(*keys, "word").agg(F.min(F.struct("place", "at")).alias("place"))
    tags = first(words, 5, F.col("word"))
    ids = nested(rows, keys, ["place"], [F.col("id")], "ids")
    texts = lambda column, f: F.transform(F.coalesce(column, F.array().cast("array<struct<summary:string>>")), f)
    joined = (
        ids.join(head.withColumnRenamed("first", "head"), keys)
        .join(long.withColumnRenamed("first", "long"), keys, "left")
        .join(tags.withColumnRenamed("first", "words"), keys, "left")
    )
    best, top = F.col("head"), F.col("head")[0]
    return joined.select(
        *keys,
        X.normalize_title(top["title"]).alias("title"),
        F.coalesce(filled(top["summary"]), top["excerpt"]).alias("summary_short"),
        F.coalesce(filled(F.array_join(texts(F.col("long"), lambda x: x["summary"]), " / ")), top["excerpt"]).alias("summary_long"),
        F.coalesce(F.transform("words", lambda x: x["word"]), F.array().cast("array<string>")).alias("tags_json"),
        F.filter(F.transform(best, lambda r: F.coalesce(filled(r["summary"]), r["excerpt"])), lambda s: filled(s).isNotNull()).alias("analysis_paragraphs_json"),
        top["id"].alias("representative_article_id"),
        F.size("ids").alias("article_count"),
        F.transform("ids", lambda x: x["id"]).alias("article_ids"),
    )


def answered(groups: DataFrame, answers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups with a model's answers where there are any, field by field.

    ``answers`` has the keys, a struct ``a`` of ``title, summary_short, summary_long, tags,
    analysis_paragraphs, representative_article_index`` (null: no answer) and ``error``, as
    :func:`briefloom.sources.feeds.model_answers` gives them; empty fields count as missing, an
    index outside the group as 0.  ``fallback_used`` says where there is no answer, ``error`` why.
    """
    got = groups.join(answers.select(*keys, "a", "error"), list(keys), "left")
    word = lambda c: F.nullif(F.col(f"a.{c}"), F.lit(""))
    some = lambda c: F.when(F.size(f"a.{c}") > 0, F.col(f"a.{c}"))
    index = F.coalesce(F.col("a.representative_article_index"), F.lit(0))
    index = F.when((index < 0) | (index >= F.size("article_ids")), 0).otherwise(index)
    return got.select(
        *keys,
        *[F.coalesce(word(c), F.col(c)).alias(c) for c in ("title", "summary_short", "summary_long")],
        F.coalesce(some("tags"), F.col("tags_json")).alias("tags_json"),
        F.coalesce(some("analysis_paragraphs"), F.col("analysis_paragraphs_json")).alias("analysis_paragraphs_json"),
        F.when(F.col("a").isNull(), F.col("representative_article_id")).otherwise(F.get("article_ids", index)).alias("representative_article_id"),
        "article_count",
        "article_ids",
        F.col("a").isNull().alias("fallback_used"),
        "error",
    )
