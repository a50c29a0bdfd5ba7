"""Map whole texts in Arrow batches, ids untouched; zstandard dictionaries in workers."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()),
}
#: Rows of an Arrow batch: the setting, its default, and what whole texts take instead.
BATCH_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000")


def small_batches(df: DataFrame) -> None:
    """Set the rows of an Arrow batch for whole texts, unless somebody has chosen another size."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_ROWS[0]) == BATCH_ROWS[1]:
        conf.set(BATCH_ROWS[0], BATCH_ROWS[2])


def map_texts(
    df: DataFrame, make: Callable[[], Callable[[list], dict[str, list]]], new: dict[str, str], keep: tuple[str, ...] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """``keep`` columns of ``df`` (as they are) and the columns ``new`` (name: type) that the mapper gives for its texts.

    ``make`` runs once a task and gives a function from a list of texts (str or None) to columns.
    """
    kept = df.select(*[df[k] for k in keep]).schema
    at_text = keep.index(text) if text in keep and dict(df.dtypes)[text] == "string" else len(keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{k}` {v}" for k, v in new.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = make()
        for b in batches:
            # few texts at a time, however long they are
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                made = use(part.column(at_text).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(k) for k in range(len(keep))] + [pa.array(made[k], ARROW[v]) for k, v in new.items()], [*keep, *new]
                )

    small_batches(df)
    columns = [df[k] for k in keep] + ([df[text].cast("string").alias("__text")] if at_text == len(keep) else [])
    return df.select(*columns).mapInArrow(run, schema)


def text_flag(make: Callable[[], Callable[[list], list]]):
    """A boolean UDF of a text column: only texts go to Python and only flags come back."""

    @F.pandas_udf(BooleanType())
    def flag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        use = make()
        for texts in batches:
            yield pd.Series([bool(x) for x in use([t if isinstance(t, str) else None for t in texts])], dtype=bool)

    return flag


@functools.lru_cache(8)
def compressor(dictionary: bytes, level: int, window: int):
    """A zstandard compressor over a raw-content dictionary; frames carry nothing but the data."""
    import zstandard as zstd

    held = zstd.ZstdCompressionDict(dictionary, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    params = zstd.ZstdCompressionParameters.from_level(
        level, source_size=window, dict_size=max(1, len(dictionary)), min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    if dictionary:
        held.precompute_compress(compression_params=params)
        return zstd.ZstdCompressor(dict_data=held, compression_params=params)
    return zstd.ZstdCompressor(compression_params=params)
