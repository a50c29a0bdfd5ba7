"""Latest rows, first rows, ranks and pages."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefloom.operators.lookup import by_value


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """A key's first row; Spark cuts each task's rows to it before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def latest_versions(pages: DataFrame, condition: Column) -> DataFrame:
    """Filter first, then the latest version of each day that is left, newest day first."""
    order = [F.col("version_no").desc(), F.col("id").desc()]
    return first_per_key(pages.where(condition), ["business_date"], order).orderBy(F.desc("business_date"), F.desc("version_no"), F.desc("id"))


def pagination(page: int, size: int, max_size: int = 100) -> tuple[int, int, int]:
    """(page, size, offset) held to 1.. and 1..max_size."""
    page, size = max(page, 1), min(max(size, 1), max_size)
    return page, size, (page - 1) * size


def paged(df: DataFrame, page: int, size: int) -> DataFrame:
    return df.offset((page - 1) * size).limit(size)


#: Rows in front of a page up to which it is simply sorted for, ranges that are counted at once, rows that are sorted for a deep page.
SHALLOW, RANGES, SORTED = 10_000, 64, 100_000


def _in_order(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc() if up else F.col(c).desc() for c, up in order]


def paged_by(df: DataFrame, order: Sequence[tuple[str, bool]], page: int, size: int) -> DataFrame:
    """A page of ``df`` by ``order``, pairs of column and whether it ascends; deep ones by :func:`deep_page`."""
    if page * size <= SHALLOW:
        return paged(df.orderBy(*_in_order(order)), page, size)
    return deep_page(df, order, page, size)


def deep_page(df: DataFrame, order: Sequence[tuple[str, bool]], page: int, size: int, most: int = SORTED) -> DataFrame:
    """A page however deep: rows are counted by ranges of the first column to find where it lies, and only there sorted.

    A range of more than ``most`` rows is counted by finer ones, and where it is one value, by those
    of the next column; a pass is a scan that brings a row a range to the driver.  Columns are
    numbers, dates or times; nulls stand where Spark sorts them, first if ascending.  ``order``
    has to be total for pages to be the same each time.
    """
    pieces = _pieces(df, order, (page - 1) * size, page * size, most)
    return reduce(DataFrame.unionByName, pieces).orderBy(*_in_order(order)) if pieces else df.limit(0)


def _pieces(df: DataFrame, order: Sequence[tuple[str, bool]], low: int, high: int, most: int) -> list[DataFrame]:
    """Rows ``low`` to ``high`` of ``df``, from as many ranges as they lie in; each of at most ``most`` rows unless all columns are equal."""
    (column, up), *rest = order
    c, kind = F.col(column), df.schema[column].dataType
    # values that occur, so that each is a range of its own and the ranges get smaller at every pass
    cuts = df.agg(F.percentile_approx(c, [k / RANGES for k in range(1, RANGES)])).first()[0] or []
    cuts = [F.lit(x).cast(kind) for x in sorted(set(cuts))]
    below = lambda test: F.size(F.filter(F.array(*cuts), test)) if cuts else F.lit(0)
    spot = F.when(c.isNotNull(), below(lambda x: x <= c) + below(lambda x: x < c))
    counted = [(r.spot, r["count"]) for r in df.groupBy(spot.alias("spot")).count().collect()]
    before, chosen = 0, []
    for at, n in sorted(counted, key=lambda r: (r[0] is not None, r[0]) if up else (r[0] is None, -(r[0] or 0))):
        if before < high and before + n > low:
            chosen.append((at, n, before))
        before += n
    cut = lambda part, lo, hi: part.orderBy(*_in_order(order)).offset(lo).limit(hi - lo)
    if chosen and sum(n for _, n, _ in chosen) <= most:
        keep = reduce(lambda a, b: a | b, [_within(c, cuts, at) for at, *_ in chosen])
        return [cut(df.where(keep), low - chosen[0][2], high - chosen[0][2])]
    out = []
    for at, n, first in chosen:
        part, lo, hi, alike = df.where(_within(c, cuts, at)), max(low - first, 0), min(high - first, n), at is None or at % 2 == 1
        out += [cut(part, lo, hi)] if n <= most or (alike and not rest) else _pieces(part, rest if alike else order, lo, hi, most)
    return out


def _within(c: Column, cuts: Sequence[Column], spot: int | None) -> Column:
    """The values of a spot: between two cuts if even, equal to one if odd, null if None."""
    if spot is None:
        return c.isNull()
    if spot % 2:
        return c == cuts[spot // 2]
    low = F.lit(True) if spot == 0 else c > cuts[spot // 2 - 1]
    return c.isNotNull() & low & (F.lit(True) if spot // 2 == len(cuts) else c < cuts[spot // 2])


def latest_page(pages: DataFrame) -> DataFrame:
    return pages.orderBy(F.desc("business_date"), F.desc("version_no")).limit(1)


def page_of_day(pages: DataFrame, day: dt.date, version_no: int | None = None) -> DataFrame:
    own = by_value(pages, "business_date", day)
    own = own if version_no is None else by_value(own, "version_no", version_no)
    return own.orderBy(F.desc("version_no")).limit(1)


def latest_cluster_summary(summaries: DataFrame, cluster_id: int, summary_type: str = "CLUSTER_DETAIL_ANALYSIS") -> DataFrame:
    own = by_value(by_value(summaries, "cluster_id", cluster_id), "summary_type", summary_type)
    return own.orderBy(F.desc("generated_at"), F.desc("id")).limit(1)


def job_list(jobs: DataFrame, condition: Column, page: int = 1, size: int = 20) -> DataFrame:
    page, size, _ = pagination(page, size)
    return paged_by(jobs.where(condition), [("business_date", False), ("started_at", False), ("job_id", False)], page, size)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """1, 2, ... within a key by a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w))


def take_while(df: DataFrame, keys: Sequence[str], place: str, stop: Column) -> DataFrame:
    """A key's rows before the first one for which ``stop`` is true."""
    w = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__stop", F.max(F.coalesce(stop, F.lit(False)).cast("int")).over(w)).where("__stop = 0").drop("__stop")
