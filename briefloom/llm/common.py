"""Shared pieces: tables, shared work folder, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders made where spark.checkpoint.dir is unset, by application.
_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir``; a temporary one only in local mode, where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, _OWN.get(spark.sparkContext.applicationId) or tempfile.mkdtemp(prefix="briefloom-"))
    return f"{base.rstrip('/')}/briefloom/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder.  Cuts the lineage; survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that no later plan reads."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete every table that :func:`written` made in this application; when no result is read from them any more."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Components of the undirected graph ``edges(u long, v long)``.

    Alternates large-star and small-star rounds until the edge set is a forest of stars.
    Returns ``(id, component)`` for every node that has an edge, ``component`` being the
    smallest id of its component.  Each round is a min-aggregation and an equi-join on the
    node, written to the shared folder; nothing reaches the driver but one checksum row.
    Self-loops and repeated edges are harmless; no edges give no rows.
    """
    now = written(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "cc",
    )
    if now.isEmpty():
        return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    seen = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of n points to the least of n and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        # small star: n and its smaller neighbours point to the least of them
        best = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(best, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        after = written(small, "cc")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.max("v")).first()
        dropped(now)
        now = after
        # a star forest: every node has one parent and a further round changes nothing
        if mark == seen or mark[0] == 0:
            break
        seen = mark
    else:
        raise RuntimeError("connected components did not settle")
    roots = now.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
