"""Which keys a table has already: key files in buckets, each with a Bloom filter.

New keys meet the filters of their buckets, and only buckets in which one of them may be are
read, to be told exactly; a run that brings new articles reads filters (three bytes a known key)
and a few buckets in place of the whole history.  Filters grow by doubling: a bucket's keys are
read again only when it has outgrown its filter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a key table; bits of a filter a key it is made for, look-ups a key (1 in 70,000 unknown keys passes).
BUCKETS, BITS, LOOKS = 64, 24, 12
#: Keys that the smallest filter is made for, and keys whose bits are worked out at once.
LEAST, PIECE = 1024, 100_000
KEY_COLUMNS = StructType().add("bucket", "integer").add("key", "string").add("id", "long")
FILTER_COLUMNS = StructType().add("bucket", "integer").add("made_for", "long").add("n", "long").add("bits", "binary")


def key_of(columns: Sequence[str | Column]) -> Column:
    """SHA-256 of the columns with their lengths; null if one of them is null."""
    parts = [F.col(c).cast("string") if isinstance(c, str) else c for c in columns]
    return F.sha2(F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]), 256)


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _hashed(keys: DataFrame) -> DataFrame:
    """(bucket, key, a, b): two independent numbers a key, from which its bits follow."""
    return keys.select("bucket", "key", F.xxhash64("key", F.lit(1)).alias("a"), F.xxhash64(F.lit(2), "key").alias("b"))


def _bits_of(pdf: pd.DataFrame, made_for: int) -> np.ndarray:
    """Places of each key's bits, a row a key."""
    a, b = pdf["a"].to_numpy().astype(np.uint64), pdf["b"].to_numpy().astype(np.uint64) | np.uint64(1)
    return ((a[:, None] + np.arange(LOOKS, dtype=np.uint64)[None, :] * b[:, None]) >> np.uint64(3)) % np.uint64(made_for * BITS)


def _met(filters: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows by bucket: first its filter ``(made_for, n, more, bits)``, then its keys; numbers are 0 where they don't apply."""
    zero = lambda *names: {c: F.lit(0).cast("long") for c in names}
    heads = filters.select("bucket", "made_for", "n", "more", "bits").withColumns({"place": F.lit(0), "key": F.lit("")} | zero("a", "b"))
    rows = _hashed(keys).withColumns({"place": F.lit(1), "bits": F.lit(None).cast("binary")} | zero("made_for", "n", "more"))
    return heads.unionByName(rows).repartition("bucket").sortWithinPartitions("bucket", "place")


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.Series | None, pd.DataFrame]]:
    """(filter, keys) of each run of one bucket in each batch; the filter only where the bucket begins, None after that."""
    for pdf in batches:
        ends = [*np.flatnonzero(np.diff(pdf["bucket"].to_numpy())) + 1, len(pdf)]
        for start, end in zip([0, *ends], ends):
            run = pdf.iloc[start:end]
            begins = end > start and run["place"].iloc[0] == 0
            yield (run.iloc[0] if begins else None), run[run["place"] == 1]


def filters_with(filters: DataFrame, keys: DataFrame, outgrown: Sequence[int]) -> DataFrame:
    """Filters of the buckets of ``keys(bucket, key)``: the old ones with the keys' bits set, new ones for ``outgrown`` and new buckets.

    Keys stream past their bucket's filter; a task holds a filter and some keys.
    """

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = bits = None
        made = lambda: pd.DataFrame({"bucket": [bucket], "made_for": [made_for], "n": [n], "bits": [bits.tobytes()]})
        for head, run in _runs(batches):
            if head is not None:
                if bits is not None:
                    yield made()
                bucket, made_for, n = int(head["bucket"]), int(head["made_for"]), int(head["n"])
                if head["bits"] is None:
                    made_for = max(LEAST, 1 << (2 * int(head["more"]) - 1).bit_length())
                    bits = np.zeros(made_for * BITS // 8, np.uint8)
                else:
                    bits = np.frombuffer(head["bits"], np.uint8).copy()
            n += len(run)
            for at in range(0, len(run), PIECE):
                spots = _bits_of(run.iloc[at : at + PIECE], made_for).ravel()
                np.bitwise_or.at(bits, spots >> np.uint64(3), np.uint8(1) << (spots & np.uint64(7)).astype(np.uint8))
        if bits is not None:
            yield made()

    kept = filters.where(~F.col("bucket").isin(list(outgrown))) if outgrown else filters
    none = F.lit(0).cast("long")
    heads = keys.groupBy("bucket").agg(F.count("*").alias("more")).join(kept, "bucket", "left").withColumns({c: F.coalesce(c, none) for c in ("made_for", "n")})
    return _met(heads, keys).drop("key").mapInPandas(merged, FILTER_COLUMNS)


def may_hold(filters: DataFrame, keys: DataFrame) -> DataFrame:
    """(bucket, key) of those ``keys(bucket, key)`` that their bucket's filter lets pass: all that are known, and few others."""

    def passed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = None
        for head, run in _runs(batches):
            if head is not None:
                bucket, made_for, bits = int(head["bucket"]), int(head["made_for"]), np.frombuffer(head["bits"], np.uint8)
            for at in range(0, len(run), PIECE):
                part = run.iloc[at : at + PIECE]
                if part["bucket"].iloc[0] != bucket:  # it has no filter
                    continue
                spots = _bits_of(part, made_for)
                set_ = bits[spots >> np.uint64(3)] >> (spots & np.uint64(7)).astype(np.uint8) & 1
                yield part[set_.all(axis=1)][["bucket", "key"]]

    return _met(filters.withColumn("more", F.lit(0).cast("long")), keys).mapInPandas(passed, "bucket int, key string")


def outgrown_by(filters: DataFrame, keys: DataFrame) -> list[int]:
    """Buckets whose filters would hold more keys than they are made for; at most a number a bucket."""
    more = keys.groupBy("bucket").agg(F.count("*").alias("more"))
    return [r.bucket for r in filters.select("bucket", "made_for", "n").join(more, "bucket").where("n + more > made_for").select("bucket").collect()]


def add(t, name: str, keys: DataFrame) -> None:
    """Put new ``keys(bucket, key, id)`` into the key table ``name`` of the store ``t`` and its filters, within its transaction."""
    filters = t.read(f"{name}_filter")
    touched = [r.bucket for r in keys.select("bucket").distinct().collect()]  # at most BUCKETS
    outgrown = outgrown_by(filters, keys)
    every = keys.select("bucket", "key")
    if outgrown:
        every = every.unionByName(t.read(name, outgrown).select("bucket", "key"))
    made = filters_with(filters.where(F.col("bucket").isin(touched)), every, outgrown)
    t.replace(f"{name}_filter", made, touched)
    t.append(name, keys)


def known(t, name: str, rows: DataFrame, columns: Sequence[str | Column]) -> DataFrame:
    """(key, id) of those keys of ``rows`` that the key table ``name`` holds; reads the filters and the buckets that may hold one."""
    keys = rows.select(key_of(columns).alias("key")).where("key is not null").distinct().withColumn("bucket", bucket_of(F.col("key")))
    maybe = may_hold(t.read(f"{name}_filter"), keys)
    buckets = [r.bucket for r in maybe.select("bucket").distinct().collect()]  # at most BUCKETS
    return t.read(name, buckets).join(keys.select("key"), "key", "left_semi").select("key", "id")


def unknown(t, name: str, rows: DataFrame, columns: Sequence[str | Column]) -> DataFrame:
    """``rows`` whose key the table doesn't hold; rows with a null in it are unknown."""
    held = known(t, name, rows, columns).select(F.col("key").alias("__key"))
    return rows.withColumn("__key", key_of(columns)).join(held, "__key", "left_anti").select(*rows.columns)
