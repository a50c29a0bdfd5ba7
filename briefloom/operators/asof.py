"""As-of joins of two long series, split by ranges of time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from briefloom.sources.tables import staged


def as_of_each(asked: DataFrame, series: DataFrame, key: str, at: str, on: str, tie: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """For each row of ``asked`` the last row of its key's ``series`` not after ``at``, and the one before that.

    Gives ``asked`` with ``carry`` (columns of the series) and ``previous_<column>`` for each, null
    where there is none.  ``on`` is the series' time, ``tie`` orders its rows of one time.

    Both sides are dealt out together by ranges of key and time, so that one key's long series
    goes to many tasks.  Each range is merged by itself; what holds at its beginning, the last
    two rows of its first key in the ranges before, is worked out from one row a range and key
    and carried in.  Null keys and times match nothing, and such rows of ``asked`` are kept.
    """
    rest = [c for c in asked.columns if c not in (key, at)]
    known = F.col(key).isNotNull() & F.col(at).isNotNull()
    given = series.where(F.col(key).isNotNull() & F.col(on).isNotNull()).select(
        F.col(key).alias("k"), F.col(on).alias("t"), F.lit(0).alias("side"), F.struct(*tie).alias("tie"), F.struct(*carry).alias("v")
    )
    wanted = asked.where(known).select(F.col(key).alias("k"), F.col(at).alias("t"), F.lit(1).alias("side"), F.struct(F.lit(0), *rest).alias("row"))
    # at one time the series' rows come before the one that asks
    both = wanted.unionByName(given, allowMissingColumns=True).repartitionByRange("k", "t", "side", "tie")
    both = staged(both.withColumn("part", F.spark_partition_id()))
    merged = _merged(both, _carried(both)).select(
        F.col("k").alias(key), F.col("t").alias(at), *[F.col(f"row.{c}").alias(c) for c in rest], *[F.col(f"found.{c}").alias(c) for c in carry],
        *[F.col(f"prior.{c}").alias(f"previous_{c}") for c in carry],
    )
    blank = {f.name: F.lit(None).cast(f.dataType) for f in merged.schema if f.name not in asked.columns}
    return merged.unionByName(asked.where(~known).withColumns(blank)).select(*merged.columns)


def _carried(both: DataFrame) -> DataFrame:
    """(part, k, last, second): the last two values before a range, for the one key of each that goes on from an earlier range."""
    newest = Window.partitionBy("part", "k").orderBy(F.desc("t"), F.desc("tie"))
    ends = both.where("side = 0").withColumn("n", F.row_number().over(newest)).where("n <= 2")
    ends = ends.groupBy("part", "k").agg(F.first(F.when(F.col("n") == 1, F.col("v")), True).alias("one"), F.first(F.when(F.col("n") == 2, F.col("v")), True).alias("two"))
    # a row a range and key
    spans = both.select("part", "k").distinct().join(ends, ["part", "k"], "left")
    earlier = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("last", F.last("one", True).over(earlier))
    # before the newest of an earlier range: the second of that range, or what was carried into it
    second = F.when(F.col("one").isNotNull(), F.struct(F.coalesce("two", "last").alias("v")))
    spans = spans.withColumn("second", F.last(second, True).over(earlier)["v"])
    return spans.where("last is not null").select("part", "k", "last", "second")


def _merged(both: DataFrame, carried: DataFrame) -> DataFrame:
    """The rows that ask, with ``found`` and ``prior``; every range by itself."""
    series = Window.partitionBy("part", "k", "side").orderBy("t", "tie")
    so_far = Window.partitionBy("part", "k").orderBy("t", "side", "tie").rowsBetween(Window.unboundedPreceding, 0)
    before = F.coalesce(F.lag("v").over(series), F.col("last"))
    rows = both.join(F.broadcast(carried), ["part", "k"], "left").withColumn("own", F.when(F.col("side") == 0, F.struct("v", before.alias("before"))))
    rows = rows.withColumn("seen", F.last("own", True).over(so_far)).where("side = 1")
    here = F.col("seen").isNotNull()
    return rows.withColumns(
        {"found": F.when(here, F.col("seen.v")).otherwise(F.col("last")), "prior": F.when(here, F.col("seen.before")).otherwise(F.col("second"))}
    )
