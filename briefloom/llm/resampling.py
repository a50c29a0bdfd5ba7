"""Importance resampling towards a target distribution.

Texts are bags of hashed n-grams of one to three words.  A bucket's gain is the log ratio of
its shares in the target and in the corpus; a document's weight is the sum of its features'
gains, looked up in one array, and a Gumbel number drawn from its id makes the greatest scores a
weighted sample without replacement.  Each task sorts the eligible documents it has scored into
runs; ranges of scores are merged from their pieces of all runs by tournament trees, and ranges
after the draw's last row are never merged.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from briefloom.llm.common import table, written
from briefloom.llm.texts import small_batches

BUCKETS, LONGEST, LEAST_WORDS = 10_000, 3, 20
#: Rows of a sorted run, of a range that is merged on average, and runs that one tree merges.
RUN, RANGE, FAN_IN = 50_000, 100_000, 512
#: Words that a worker remembers, and words whose features are worked out at once.
HELD, PIECE = 500_000, 200_000
#: To words: A-Z in lower case, what no word holds becomes a space.
WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def _byte_table() -> np.ndarray:
    """CRC-32 of each byte value, the reflected polynomial 0xEDB88320."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


class Checksums:
    """CRC-32 of joined strings from the checksums of their parts.

    crc(a + b) is crc(a) moved on by the length of b, xor crc(b); moving on is linear over bits, so
    that it is four look-ups, one for each byte, in the table of a length.
    """

    SHORT = 64

    def __init__(self):
        one = _byte_table()
        moved = np.array([[v << (8 * j) for v in range(256)] for j in range(4)], np.uint32)
        tables = []
        for _ in range(self.SHORT):
            tables.append(moved)
            moved = (moved >> 8) ^ one[moved & 255]
        self.short = np.ascontiguousarray(np.stack(tables))  # by length, byte and its value
        self.powers = [moved]  # of 64, 128, 256, ... bytes
        for _ in range(40):
            self.powers.append(self._moved(self.powers[-1], self.powers[-1]))

    @staticmethod
    def _moved(by: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return by[0][crc & 255] ^ by[1][(crc >> 8) & 255] ^ by[2][(crc >> 16) & 255] ^ by[3][crc >> 24]

    def joined(self, first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
        """CRC-32 of both strings in a row, from each one's and the second's length in bytes."""
        flat, at = self.short.reshape(-1), (length & (self.SHORT - 1)) << 10
        out = flat[at + (first & 255)] ^ flat[at + 256 + ((first >> 8) & 255)] ^ flat[at + 512 + ((first >> 16) & 255)] ^ flat[at + 768 + (first >> 24)]
        rest, k = length >> 6, 0
        while rest.any():
            own = np.flatnonzero(rest & 1)
            out[own] = self._moved(self.powers[k], out[own])
            rest, k = rest >> 1, k + 1
        return out ^ second


class Features:
    """Buckets of a text's n-grams, whole texts a piece at a time."""

    def __init__(self, buckets: int = BUCKETS, longest: int = LONGEST):
        self.buckets, self.longest, self.sums, self.seen = buckets, longest, Checksums(), {}

    def words(self, text: str | None) -> list[bytes]:
        return (text or "").encode("utf-8", "replace").translate(WORDS).split()

    def _crcs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        seen = self.seen
        if len(seen) > HELD:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = zlib.crc32(w) | len(w) << 32
        packed = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
        return packed & 0xFFFFFFFF, packed >> 32

    def of(self, words: list[bytes]) -> Iterator[np.ndarray]:
        """Arrays of the buckets of all runs of 1 to ``longest`` words."""
        space = np.int64(zlib.crc32(b" "))
        for at in range(0, len(words), PIECE):
            own = min(PIECE, len(words) - at)
            crc, length = self._crcs(words[at : at + own + self.longest - 1])
            run = crc
            for n in range(self.longest):
                if n:
                    ones = np.ones(len(run) - 1, np.int64)
                    run = self.sums.joined(self.sums.joined(run[:-1], space, ones), crc[n:], length[n:])
                yield run[:own] % self.buckets
                if len(run) < 2:
                    break


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n) of all features of ``texts(text)``; a task adds up its own before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(buckets, longest), np.zeros(buckets, np.int64)
        for b in batches:
            for text in b.column(0):
                for found in features.of(features.words(text.as_py())):
                    total += np.bincount(found, minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["bucket", "n"])

    small_batches(texts)
    parts = texts.select(F.col("text").cast("string")).mapInArrow(count, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of shares) of each bucket; at most ``buckets`` rows of either side reach the driver."""
    got = []
    for texts in (target, corpus):
        n = np.zeros(buckets, np.int64)
        for r in bucket_counts(texts, buckets, longest).collect():
            n[r.bucket] = r.n
        got.append(n)
    t, s = got
    total_t, total_s = int(t.sum()), int(s.sum())
    return np.array(
        [math.floor(1000 * math.log((int(a) + 1) * (total_s + buckets) / ((int(b) + 1) * (total_t + buckets)))) for a, b in zip(t, s)], np.int64
    )


def scored(docs: DataFrame, gains: np.ndarray, seed: int = 42, least_words: int = LEAST_WORDS, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_features, weight, score, eligible, run, place): every document, the eligible ones of a task in sorted runs.

    ``run`` and ``place`` together name a row.
    """
    held = docs.sparkSession.sparkContext.broadcast(gains)  # one number a bucket
    names = ["doc_id", "n_features", "weight", "score", "eligible", "run", "place"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, features = held.value, Features(len(held.value), longest)
        first = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def sorted_run(number: int) -> pa.RecordBatch:
            rows.sort(key=lambda r: (not r[4], -(r[3] or 0), r[0] or 0, r[1]))
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))]
            made = pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(rows), first + number)), pa.array(np.arange(len(rows)))], names)
            rows.clear()
            return made

        number = 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = features.words(text.as_py())
                n = weight = 0
                for found in features.of(words):
                    n, weight = n + len(found), weight + int(gain[found].sum())
                if doc_id is None:
                    rows.append((None, n, weight, None, False))
                    continue
                h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
                gumbel = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
                rows.append((doc_id, n, weight, weight + gumbel, len(words) >= least_words))
                if len(rows) == RUN:
                    yield sorted_run(number)
                    number += 1
        if rows:
            yield sorted_run(number)

    small_batches(docs)
    kind = "doc_id long, n_features long, weight long, score long, eligible boolean, run long, place long"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(score, kind)


class Tournament:
    """Merges sorted runs: every inner node keeps the loser of its match, so a new entry plays only along its own path."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at, k = runs, [0] * len(runs), 1
        while k < len(runs):
            k *= 2
        self.k, self.losers = k, [0] * k
        level = {k + i: i for i in range(k)}
        for node in range(k - 1, 0, -1):
            a, b = level.pop(2 * node), level.pop(2 * node + 1)
            level[node], self.losers[node] = (a, b) if self._head(a) <= self._head(b) else (b, a)
        self.winner = level[1]

    def _head(self, run: int) -> tuple:
        if run >= len(self.runs) or self.at[run] >= len(self.runs[run]):
            return (math.inf,)
        return self.runs[run][self.at[run]]

    def __iter__(self) -> Iterator[tuple]:
        while True:
            best = self._head(self.winner)
            if best[0] == math.inf:
                return
            yield best
            self.at[self.winner] += 1
            own, node = self.winner, (self.k + self.winner) // 2
            while node:
                if self._head(self.losers[node]) < self._head(own):
                    own, self.losers[node] = self.losers[node], own
                node //= 2
            self.winner = own


def merged(runs: list[list[tuple]], fan_in: int = FAN_IN) -> Iterator[tuple]:
    """All entries in order; more than ``fan_in`` runs are merged to longer ones first."""
    while len(runs) > fan_in:
        runs = [list(Tournament(runs[at : at + fan_in])) for at in range(0, len(runs), fan_in)]
    return iter(Tournament(runs)) if runs else iter(())


def drawn(rows: DataFrame, count: int) -> DataFrame:
    """(run, place, rank) of the ``count`` greatest of ``rows(score, doc_id, run, place)``, ties to the smaller doc_id.

    Rows are dealt out by ranges of the order, of about RANGE rows; a range's rank starts
    after the rows of the ranges before it, and those that start after the draw are left alone.
    """
    parts = max(1, -(-rows.count() // RANGE))
    order = [F.desc("score"), F.col("doc_id"), F.col("run"), F.col("place")]
    ranges = written(rows.select("score", "doc_id", "run", "place").repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row a range
    before = ranges.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before")).where(F.col("before") < count)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["before"].iloc[0])
        pdf = pdf.sort_values(["run", "place"])
        runs = [list(zip((-own["score"]).tolist(), own["doc_id"].tolist(), own["run"].tolist(), own["place"].tolist())) for _, own in pdf.groupby("run", sort=False)]
        out = []
        for rank, (_, _, run, place) in enumerate(merged(runs), first + 1):
            if rank > count:
                break
            out.append((run, place, rank))
        return pd.DataFrame(out, columns=["run", "place", "rank"], dtype="int64")

    return ranges.join(F.broadcast(before), "part").groupBy("part").applyInPandas(merge, "run long, place long, rank long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, least_words: int = LEAST_WORDS) -> DataFrame:
    """Every document with its n_features, weight, score and, if drawn, rank.

    Of the N documents of ``least_words`` words or more, floor(``percent`` * N / 100) are drawn.

    Defined cases: a null text has no words (weight 0); a document without a doc_id has a
    weight but no score and is never drawn; repeated rows are scored and drawn each for itself;
    other columns are ignored; an empty target leaves gains of the smoothing alone; an empty
    table gives no rows.
    """
    rows = written(scored(docs, gains_of(docs, target), seed, least_words), "scored")
    able = rows.where("eligible")
    ranks = drawn(able, percent * able.count() // 100)
    return rows.join(ranks, ["run", "place"], "left").select("doc_id", "n_features", "weight", "score", "rank")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
