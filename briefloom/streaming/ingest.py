"""Incremental intake of raw articles: each micro-batch appends the keys the table lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from briefloom.operators.ranking import first_per_key
from briefloom.sources.store import Tables
from briefloom.sources.tables import staged, with_ids

KEYS = ["provider_name", "provider_article_key"]


def append_new(tables: Tables, batch: DataFrame) -> None:
    """Append a batch's new raw articles; running it twice appends nothing more."""
    rows = batch.withColumn("collected_at", F.current_timestamp()).withColumn("created_at", F.current_timestamp())
    first = staged(first_per_key(rows, KEYS, [F.col("published_at").desc_nulls_last(), F.col("title")]))
    new = with_ids(tables.unknown("news_article_raw", first), tables.top("news_article_raw"), KEYS)
    tables.append("news_article_raw", new)


def ingest(stream: DataFrame, tables: Tables, checkpoint: str, **trigger) -> StreamingQuery:
    """Run :func:`append_new` on every micro-batch of ``stream``."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: append_new(tables, batch))
    return writer.trigger(**(trigger or {"availableNow": True})).start()
