"""Turns of conversations: cleaned, placed within their conversation, joined in blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefloom.llm.common import written

#: Turns of a conversation that a join by conversation deals to one task.
BLOCK = 1024
ORDER = ("turn", "role", "digest")


def said(role: Column, text: Column) -> Column:
    """16 bytes that stand for a turn's role and text."""
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))


def turn_rows(conversations: DataFrame, **more: Column) -> DataFrame:
    """(conv_id, turn, role, text, digest, and ``more``): null roles and texts empty, rows without a conv_id left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = conversations.where(F.col("conv_id").isNotNull())
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), said(role, text).alias("digest"), *[c.alias(k) for k, c in more.items()])


def numbered(rows: DataFrame, key: str = "conv_id", order: Sequence[str] = ORDER) -> DataFrame:
    """``rows`` with ``place``, from 0 within each key by ``order`` (nulls first).

    Rows are dealt out by ranges of key and order, so that a key with very many rows is split;
    a range counts its own rows, and what earlier ranges hold of its first key is added.
    """
    ranges = written(rows.repartitionByRange(key, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    own = ranges.withColumn("__n", F.row_number().over(Window.partitionBy("__part", key).orderBy(*order)))
    earlier = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # at most one key a range goes on from an earlier one
    before = ranges.groupBy("__part", key).count().select("__part", key, F.sum("count").over(earlier).alias("__before")).where("__before > 0")
    place = (F.col("__n") - 1 + F.coalesce("__before", F.lit(0))).cast("long")
    return own.join(F.broadcast(before), ["__part", key], "left").withColumn("place", place).select(*rows.columns, "place")


def by_blocks(turns: DataFrame, info: DataFrame, first: Column | None = None, key: str = "conv_id", size: str = "n") -> DataFrame:
    """``turns`` inner joined with ``info``, a row a conversation, the turns of a conversation dealt out in blocks.

    ``size`` is the column of ``info`` with the conversation's number of turns, ``first`` the
    place of the first turn asked for.
    """
    block = lambda c: F.floor(c / BLOCK).cast("long")
    low = F.lit(0).cast("long") if first is None else block(first)
    last = F.greatest(block(F.col(size) - 1), low)
    wide = info.where(F.col(size) > 0).withColumn("__block", F.explode(F.sequence(low, last)))
    return turns.withColumn("__block", block(F.col("place"))).join(wide, [key, "__block"]).drop("__block")


def sums_from(df: DataFrame, value: str, name: str, key: str = "conv_id") -> DataFrame:
    """``df`` with ``name``: ``value`` summed over a key's rows from this ``place`` on, a block's total at a time."""
    blocked = df.withColumn("__block", F.floor(F.col("place") / BLOCK).cast("long"))
    totals = blocked.groupBy(key, "__block").agg(F.sum(value).alias("__total"))
    later = Window.partitionBy(key).orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    after = totals.select(key, "__block", F.coalesce(F.sum("__total").over(later), F.lit(0)).alias("__after"))
    within = Window.partitionBy(key, "__block").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    return blocked.join(after, [key, "__block"]).withColumn(name, F.sum(value).over(within) + F.col("__after")).drop("__block", "__after")
