"""Counts, averages and next numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def status_summary(jobs: DataFrame) -> DataFrame:
    """One row even if there are no jobs: total, counts of three statuses, rounded mean duration."""
    count = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(f"{s.lower()}_count")
    return jobs.agg(
        F.count("*").alias("total_count"),
        count("SUCCESS"),
        count("PARTIAL"),
        count("FAILED"),
        F.coalesce(F.round(F.avg("duration_seconds")).cast("int"), F.lit(0)).alias("avg_duration_seconds"),
    )


def next_number(df: DataFrame, column: str = "version_no") -> DataFrame:
    """One row: the greatest number and one, 1 without rows."""
    return df.agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias(f"next_{column}"))


def distinct_days(df: DataFrame, condition, column: str = "business_date") -> DataFrame:
    return df.where(condition).agg(F.countDistinct(column).alias("total_count"))


def grouped_lists(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """A key's values as an array in the given order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__value"))))
    return df.groupBy(*keys).agg(F.transform(rows, lambda r: r["__value"]).alias(name))


def keyword_counts(items: DataFrame, inserted: DataFrame) -> DataFrame:
    """Per keyword: items fetched, of the business day, newly inserted."""
    a = items.groupBy("keyword_id").agg(F.count("*").alias("fetched"), F.count(F.when(F.col("matched"), 1)).alias("candidates"))
    b = inserted.groupBy("keyword_id").agg(F.count("*").alias("inserted"))
    return a.join(b, "keyword_id", "left").withColumn("inserted", F.coalesce("inserted", F.lit(0)))


def fallback_count(summaries: DataFrame) -> DataFrame:
    return fallback_counts(summaries, []).select("fallback_count")


def fallback_counts(summaries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows and fallbacks of each group; one row without keys, whatever there is."""
    return summaries.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("fallback_used").cast("int")), F.lit(0)).alias("fallback_count"))
