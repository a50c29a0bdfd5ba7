"""Tables by validated name, and the writes the briefing makes to them.

Each write is a DataFrame of what a table, or the partitions it touches, hold afterwards;
:class:`~briefloom.sources.store.Tables` puts it down and publishes it.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from briefloom.functions.text import keyword_key
from briefloom.functions.values import whole_seconds
from briefloom.schemas import ENUMS

NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def qualified(name: str, schema: str | None = None) -> str:
    """``schema.name``; anything but plain identifiers is rejected before it gets near a query."""
    for part in (name, schema):
        if part is not None and not NAME.match(part):
            raise ValueError(f"not an identifier: {part!r}")
    return f"{schema}.{name}" if schema else name


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors share; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="briefloom-")


def staged(df: DataFrame) -> DataFrame:
    """``df`` as it is now, in the shared folder.

    The files go with the DataFrame where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set; else with the folder.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


# What a table holds after a write ---------------------------------------------------------


def in_place(df: DataFrame, name: str) -> DataFrame:
    """The rows of an ordered DataFrame with their place, from 0.

    Its sorted partitions are staged as they are and counted; nothing is sorted or brought together again.
    """
    seen = staged(df.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    # a row a partition
    before = seen.groupBy(part.alias("__part")).agg(F.count("*").alias("__size")).select(
        "__part", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before")
    )
    placed = seen.withColumn("__part", part).join(F.broadcast(before), "__part")
    return placed.select((F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name), *df.columns)


def with_ids(rows: DataFrame, existing: DataFrame | int, order: Sequence[str], column: str = "id") -> DataFrame:
    """New rows numbered on from the greatest id, by ``order``; ``existing`` is the table or that id.

    Rows are counted by range first, so that no task has to see all of them; the ranges are
    staged, so that both looks see the same ones.
    """
    top = existing if isinstance(existing, int) else existing.agg(F.max(column)).first()[0] or 0
    ranges = rows.drop(column).repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    placed = staged(ranges).withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    # a row a range
    before = placed.groupBy("__part").agg(F.count("*").alias("__size")).withColumn(
        "__before", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    out = placed.join(F.broadcast(before.select("__part", "__before")), "__part")
    return out.select((F.lit(top) + F.col("__before") + F.col("__n")).cast("long").alias(column), *[c for c in rows.columns if c != column])


def insert_ignore(rows: DataFrame, existing: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows to append: the first of each key, if the table doesn't have the key."""
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
    return first.join(existing.select(*keys), list(keys), "left_anti").select(*rows.columns)


def get_or_create(rows: DataFrame, existing: DataFrame, keys: Sequence[str], order: Sequence[str], id_column: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows to append, with ids; id of every key asked for, old or new)."""
    new = with_ids(insert_ignore(rows, existing, keys, [F.col(c) for c in order]), existing, order, id_column)
    known = existing.select(*keys, F.col(id_column)).unionByName(new.select(*keys, id_column))
    return new, rows.select(*keys).distinct().join(known, list(keys))


def upsert(existing: DataFrame, rows: DataFrame, keys: Sequence[str], keep: Sequence[str] = ("id", "created_at")) -> DataFrame:
    """The table with ``rows`` over it; a known key keeps its ``keep`` columns."""
    a = existing.select(*[F.col(c).alias(f"a_{c}") if c not in keys else F.col(c) for c in existing.columns], F.lit(True).alias("__old"))
    b = rows.select(*[F.col(c).alias(f"b_{c}") if c not in keys else F.col(c) for c in rows.columns], F.lit(True).alias("__new"))
    both = a.join(b, list(keys), "full")
    pick = [
        F.col(c) if c in keys
        else F.col(f"a_{c}") if c not in rows.columns
        else F.when(F.col("__old") & F.lit(c in keep) | F.col("__new").isNull(), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(c)
        for c in existing.columns
    ]
    return both.select(*[p.alias(c) for p, c in zip(pick, existing.columns)])


def replace_set(existing: DataFrame, rows: DataFrame, owners: DataFrame, owner: str) -> DataFrame:
    """The table with the owners' rows replaced by ``rows``."""
    return existing.join(owners.select(owner), owner, "left_anti").select(*existing.columns).unionByName(rows.select(*existing.columns))


def members_of(bundles: DataFrame, owner: str = "cluster_id", ids: str = "article_ids") -> DataFrame:
    """(owner, processed_article_id, article_rank) of arrays of ids, ranks from 1."""
    return bundles.select(owner, F.posexplode(ids).alias("__k", "processed_article_id")).select(
        owner, "processed_article_id", (F.col("__k") + 1).alias("article_rank")
    )


def delete(existing: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """The table without rows whose ``key`` is among ``gone``; also what a cascade leaves of a child table."""
    return existing.join(gone.select(F.col("id").alias(key)), key, "left_anti").select(*existing.columns)


def set_null(existing: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The table with ``key`` null where it is among ``gone``."""
    g = gone.select(F.col("id").alias(key), F.lit(True).alias("__gone")).distinct()
    out = existing.join(g, key, "left").withColumn(key, F.when(F.col("__gone").isNull(), F.col(key)))
    return out.select(*existing.columns)


def patch(existing: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """The table with non-null values of ``changes`` put in; an empty string is a value."""
    new = [c for c in changes.columns if c != key]
    c = changes.select(key, *[F.col(n).alias(f"__{n}") for n in new])
    joined = existing.join(c, key, "left")
    return joined.select(*[F.coalesce(f"__{n}", n).alias(n) if n in new else F.col(n) for n in existing.columns])


def case_update(df: DataFrame, key: str, **values: dict) -> DataFrame:
    """The table with columns set by key where a value is given for it, other rows as they are."""
    kinds = dict(df.dtypes)

    def cases(column: str, by_key: dict) -> Column:
        out = F.col(column)
        for k, v in by_key.items():
            out = F.when(F.col(key) == F.lit(k), F.lit(v).cast(kinds[column])).otherwise(out)
        return out

    return df.withColumns({c: cases(c, v) for c, v in values.items()})


def new_keyword(keywords: DataFrame, provider_name: str, market_type: str, keyword: str, now: Column, is_active: bool = True, priority: int = 1) -> DataFrame:
    """The row to append for a search keyword, with its id; ValueError where the table's rules forbid it."""
    if not provider_name.strip() or not keyword.strip() or priority <= 0 or market_type not in ENUMS["market_type"]:
        raise ValueError("a provider, a keyword, a known market and a priority above 0 are needed")
    key = keyword_key(F.lit(keyword))
    same = (F.col("provider_name") == F.lit(provider_name)) & (F.col("market_type") == F.lit(market_type)) & (keyword_key(F.col("keyword")) == key)
    if not keywords.where(same).isEmpty():
        raise ValueError(f"the keyword is there already: {keyword!r}")
    top = keywords.agg(F.max("id")).first()[0] or 0
    row = keywords.sparkSession.createDataFrame(
        [(top + 1, provider_name, market_type, keyword, is_active, priority)],
        "id long, provider_name string, market_type string, keyword string, is_active boolean, priority int",
    )
    return row.withColumns({"created_at": now, "updated_at": now})


def complete_job(jobs: DataFrame, job_id: int, now: Column, **values) -> DataFrame:
    """The jobs with one of them ended: its values, end and rounded duration."""
    mine = F.col("job_id") == job_id
    ended = {k: F.lit(v) for k, v in values.items()} | {
        "ended_at": now,
        "updated_at": now,
        "duration_seconds": whole_seconds(now, F.col("started_at")),
    }
    kinds = dict(jobs.dtypes)
    return jobs.select(*[F.when(mine, ended[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in ended else F.col(c) for c in jobs.columns])
