"""N-gram Jaccard join by MinHash banding.

Words are the runs of letters and digits of the lower-cased text, n-grams the sets of
``n`` consecutive words (a text of fewer words is one n-gram).  Texts with equal word
sequences form one class and are compared once.  Signatures are cut in bands; a shuffle on
band hashes finds texts that share a band, and pairs are verified on their full n-gram sets.

The verification never emits pairs.  Texts reached through shared bands are dealt to tasks
by candidate group, a group of more than ``BLOCK_GRAMS`` n-grams being cut in blocks that
are compared block against block; a task returns one count and one spanning edge a text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from briefloom.llm.blocks import block_cells, compared
from briefloom.llm.common import connected_components, table, written
from briefloom.llm.texts import map_texts

WORDS = re.compile(r"[^\W_]+")
#: n-grams of one side of a verification task (8 bytes each), and what a text counts besides its own,
#: which bounds the texts of a side and so the pairs of a task.
BLOCK_GRAMS, TEXT_GRAMS = 400_000, 200
#: Candidate texts up to this count are broadcast (24 bytes each); beyond it they are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def band_plan(threshold: float, recall: float, rows: int = 6) -> tuple[int, int]:
    """(bands, rows): the fewest bands of ``rows`` values that find a pair at ``threshold`` with ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def key_of(words: list[str]) -> bytes | None:
    return hashlib.md5("\x1f".join(words).encode("utf-8", "surrogatepass")).digest() if words else None


def grams(words: list[str], n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(n, len(h))
    g = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    return np.unique(g)


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.RandomState(20)
    return (r.randint(0, 2**31, count).astype(np.uint32) * np.uint32(2) + np.uint32(1)), r.randint(0, 2**32, count, dtype=np.uint32)


def band_hashes(g: np.ndarray, bands: int, rows: int, perms: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = perms
    low = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    x = (g >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(x), 4096):
        v = a[:, None] * x[None, k : k + 4096]
        v += b[:, None]
        v ^= v >> np.uint32(15)
        np.minimum(low, v.min(axis=1), out=low)
    m = low.reshape(bands, rows).astype(np.uint64)
    out = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for k in range(rows):
        out = (out ^ m[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, key, n_grams, bands): ``key`` equal for equal word sequences, null for texts without words."""

    def make():
        perms = _permutations(bands * rows)

        def use(texts):
            keys, counts, hashes = [], [], []
            for text in texts:
                w = words_of(text)
                g = grams(w, n)
                counts.append(len(g))
                keys.append(key_of(w))
                hashes.append(band_hashes(g, bands, rows, perms) if w else None)
            return {"key": keys, "n_grams": counts, "bands": hashes}

        return use

    return map_texts(docs, make, {"key": "binary", "n_grams": "long", "bands": "array<long>"}).withColumn("doc_id", F.col("doc_id").cast("long"))


def links_within(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Boolean matrix of pairs of ``a`` x ``b`` (``a`` x ``a`` without the diagonal) with Jaccard >= threshold."""
    both = a if b is None else a + b
    sizes = np.array([len(x) for x in both])
    grams_, col = np.unique(np.concatenate(both), return_inverse=True)
    row = np.repeat(np.arange(len(both)), sizes)
    many = np.bincount(col, minlength=len(grams_)) > 1
    slot = np.cumsum(many) - 1
    row, col = row[many[col]], slot[col[many[col]]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    na, nb = len(a), len(a) if b is None else len(b)
    inter = np.zeros((na, nb), np.float32)
    width = max(64, min(4096, 2_000_000 // max(1, len(both))))
    total = int(many.sum())
    for at in range(0, total, width):
        lo, hi = np.searchsorted(col, (at, at + width))
        dense = np.zeros((len(both), min(width, total - at)), np.float32)
        dense[row[lo:hi], col[lo:hi] - at] = 1
        inter += dense[:na] @ (dense if b is None else dense[na:]).T
    sa, sb = sizes[:na], sizes[:na] if b is None else sizes[na:]
    # |x & y| >= t |x u y| without a division, some rows at a time
    hit = np.empty((na, nb), bool)
    for at in range(0, na, 256):
        rows = slice(at, at + 256)
        hit[rows] = inter[rows].astype(np.float64) * (1 + threshold) >= threshold * (sa[rows, None] + sb[None, :]) - 1e-6
    if b is None:
        np.fill_diagonal(hit, False)
    return hit


def ngram_jaccard_join(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, rows: int = 6
) -> DataFrame:
    """Link documents whose n-gram sets have Jaccard similarity >= ``threshold``.

    Returns one row per input row: ``doc_id``, ``class_id`` (smallest doc_id reachable by
    links, itself included), ``text_class_id`` (smallest doc_id with the same words),
    ``n_links`` (other rows linked directly) and ``kept`` (``doc_id = class_id``).

    Defined cases: a null or wordless text links with nothing and is kept; a null doc_id is
    kept with no links and null ids; repeated rows are copies of each other; a doc_id on rows
    of different texts gets the links of all of them; an empty table gives no rows; further
    columns are ignored.
    """
    sig, linked = _linked(docs, n, threshold, recall, rows)
    return sig.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(linked, "key", "left").select(
        "doc_id",
        F.coalesce("class", "doc_id").alias("class_id"),
        F.coalesce("rep", "doc_id").alias("text_class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == F.coalesce("class", "doc_id"))).alias("kept"),
    )


def _linked(docs: DataFrame, n: int, threshold: float, recall: float, rows: int = 6, by_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """:func:`signatures`, and (key, rep, links, class) of the word sequences on several rows or with links.

    ``rep`` is the smallest doc_id of a word sequence.  Texts of one ``rep`` are one node of the
    links and ``class`` is its component's smallest doc_id; with ``by_text`` each text is a node
    of its own, and ``class`` is a number of the component.
    """
    spark = docs.sparkSession
    bands, rows = band_plan(threshold, recall, rows)
    sig = written(signatures(docs, n, bands, rows), "signatures")
    full = sig.where("doc_id is not null and key is not null")
    node = F.monotonically_increasing_id() if by_text else F.col("rep")
    classes = written(
        full.groupBy("key")
        .agg(F.min("doc_id").alias("rep"), F.count("*").alias("mult"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
        .withColumn("node", node),
        "classes",
    )
    banded = classes.select(F.col("node").alias("rep"), F.explode("bands").alias("h"))
    shared = banded.groupBy("h").agg(F.min("rep").alias("m"), F.count("*").alias("c")).where("c > 1").select("h", "m")
    groups = connected_components(banded.join(shared, "h").select(F.col("rep").alias("u"), F.col("m").alias("v")))
    grouped = classes.select("key", "rep", "node", "mult", "n_grams").join(groups.withColumnRenamed("id", "node"), "node")
    weight = grouped.groupBy("component").agg(F.sum(F.col("n_grams") + TEXT_GRAMS).alias("w"))
    candidates = written(
        grouped.join(weight, "component").select(
            F.col("rep").alias("doc_id"), "node", "key", "mult", "component", F.ceil(F.col("w") / BLOCK_GRAMS).cast("int").alias("blocks"), "n_grams"
        ),
        "candidates",
    )
    size = candidates.agg(F.count("*").alias("rows"), F.sum(F.col("n_grams") + TEXT_GRAMS).alias("w")).first()
    bins = max(1, math.ceil((size.w or 0) / BLOCK_GRAMS))

    def regram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [grams(w, n).tobytes() if key_of(w) == k else None for w, k in zip(map(words_of, pdf["text"]), pdf["key"])]
            pdf = pdf.drop(columns=["text", "key"]).assign(grams=own)
            yield pdf[pdf["grams"].notna()][["node", "mult", "component", "blocks", "grams"]]

    cand = candidates.select("doc_id", "node", "key", "mult", "component", "blocks")
    cand = F.broadcast(cand) if size.rows <= BROADCAST_ROWS else cand
    texts = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .where("doc_id is not null and text is not null")
        .join(cand, "doc_id")
        .mapInPandas(regram, "node long, mult long, component long, blocks int, grams binary")
    )
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = block_cells(F.col("block"), F.col("blocks"))
    dealt = (
        texts.withColumn("block", block)
        .select("node", "mult", "component", "blocks", "grams", F.explode(cells).alias("cell"))
        .select(
            F.when(F.col("blocks") == 1, F.concat(F.lit("s"), F.pmod(F.xxhash64("component"), F.lit(bins))))
            .otherwise(F.concat_ws("-", "component", "cell.i", "cell.j"))
            .alias("task"),
            F.col("component").alias("sub"),
            F.col("cell.side").alias("side"),
            F.col("node").alias("rep"),
            "mult",
            "grams",
        )
    )
    def hits(a: list[bytes], b: list[bytes] | None) -> np.ndarray:
        read = lambda side: [np.frombuffer(x, np.uint64) for x in side]
        return links_within(read(a), None if b is None else read(b), threshold)

    found = written(compared(dealt, "grams", hits), "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    linked = (
        classes.select("key", "rep", "node", "mult")
        .join(counts.withColumnRenamed("rep", "node"), "node", "left")
        .join(parts.withColumnRenamed("id", "node"), "node", "left")
        .where("mult > 1 or links is not null")
        .select("key", "rep", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "node").alias("class"))
    )
    return sig, linked


@F.pandas_udf(BinaryType())
def _key(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: key_of(words_of(t)))


def deduplicated(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """``docs`` with one row of each group of linked texts, one with the smallest doc_id; columns as they are.

    Rows with a null doc_id stay, as do wordless texts but for repeated rows (equal doc_id and
    text), of which one stays.  Texts are told apart by their words, also where they share a doc_id.
    """
    sig, linked = _linked(docs, n, threshold, recall, by_text=True)
    linked = written(linked.select("key", "rep", "class"), "linked")
    first = linked.groupBy("class").agg(F.min(F.struct("rep", "key")).alias("first"))
    winner = linked.join(first, "class").select("key", F.when(F.col("key") == F.col("first.key"), F.col("rep")).alias("winner"), F.lit(True).alias("in_group"))
    rows = sig.where("doc_id is not null").select("doc_id", "key").join(winner, "key", "left")
    kept = F.col("in_group").isNull() | F.coalesce(F.col("doc_id") == F.col("winner"), F.lit(False))
    rows = written(rows.select("doc_id", "key", kept.alias("kept")), "kept")
    # doc_ids with a row that goes, which is all of their rows or needs a look at the texts
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("rows"), F.count(F.when(F.col("kept"), 1)).alias("kept"))
    ids = written(ids.where("rows > 1 or kept = 0"), "gone")
    gone, mixed = ids.where("kept = 0").select("doc_id"), ids.where("kept > 0").select("doc_id")
    few, many = gone.count(), mixed.count()
    left = docs.join(F.broadcast(gone) if few <= BROADCAST_ROWS else gone, "doc_id", "left_anti")
    if many:
        some = F.broadcast(mixed) if many <= BROADCAST_ROWS else mixed
        drop = rows.where("not kept").join(some, "doc_id", "left_semi").select("doc_id", F.col("key").alias("__key")).distinct()
        text = F.col("text").cast("string")
        own = left.join(some, "doc_id", "left_semi").withColumn("__key", _key(text)).join(drop, ["doc_id", "__key"], "left_anti")
        once = own.withColumn("__key", F.coalesce("__key", F.encode(text, "UTF-8"))).dropDuplicates(["doc_id", "__key"]).drop("__key")
        left = left.join(some, "doc_id", "left_anti").unionByName(once.select(*docs.columns))
    return left.select(*docs.columns)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))
