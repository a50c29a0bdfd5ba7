"""Language identification by compression.

Each language has a zstandard raw-content dictionary of sample text.  A text is encoded in
windows with every dictionary; the language of the smallest encoding is chosen, and a text
whose margin over the next one is narrow is rejected.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from briefloom.llm.common import table
from briefloom.llm.texts import compressor, map_texts, small_batches, text_flag

UNDETERMINED = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Training rows of a language and bytes taken from one of them; all of them make its dictionary (33 kB).
SAMPLE_ROWS, ROW_BYTES = 128, 256
#: Languages that are learned: those with the most rows.  Each text is encoded with every one's dictionary.
LANGUAGES = 64
#: Values whose numbers of rows are broadcast; more are joined by shuffle.
BROADCAST_VALUES = 10_000
#: Bytes encoded at once, and the level.
WINDOW, LEVEL = 512, 9
#: Put after a short window: alone it would be stored as it is, at one size for all languages.
FILLER = b" " * 128
#: Below this share of the smallest size the margin is narrow.
NARROW = 0.005


def letters_of(text: str | None) -> bytes:
    """Lower-cased words, one space between them; empty if the text has no letter."""
    if not text:
        return b""
    words = NOT_LETTERS.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, words)):
        return b""
    return words.encode("utf-8", "surrogatepass")


def hash_share(key: str):
    """A number from 0 to 1 by the hash of ``key``."""
    return F.xxhash64(key).cast("double") / float(2**64) + 0.5


def sample(rows: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """About ``most`` rows, and no more, for each value of ``by``: those with the smallest hash of ``key``.

    The numbers of rows (a row a value) are broadcast, up to ``BROADCAST_VALUES`` of them, so that a share of each
    value's rows that holds enough is taken by hash where they are read: no more than about
    twice ``most`` rows of a value move, whatever the table holds.
    """
    own = rows.where(F.col(by).isNotNull() & F.col(key).isNotNull())
    counts = own.groupBy(by).agg(F.count("*").alias("__rows"))
    counts = F.broadcast(counts) if counts.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES else counts
    near = own.join(counts, by).where(hash_share(key) * F.col("__rows") <= 2.0 * most)
    order = Window.partitionBy(by).orderBy(F.xxhash64(key), key, *[c for c in rows.columns if c not in (by, key)])
    return near.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).select(*rows.columns)


def train_languages(labelled: DataFrame) -> dict[str, bytes]:
    """Dictionaries by language from ``labelled(doc_id, text, lang)``.

    Takes a stretch of ``ROW_BYTES`` of each of a language's ``SAMPLE_ROWS`` rows, from a place
    the id's hash gives (documented bounds of the training sample); no rows give no languages.
    Of more than ``LANGUAGES`` values of ``lang`` those with the most rows are learned (ties by
    name); rarer ones, which may be junk, are never predicted.
    """
    letters = 4 * ROW_BYTES
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - letters, F.lit(0)) + 1) + 1
    stretch = F.substring(F.col("text"), start.cast("int"), F.lit(letters)).alias("text")
    own = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "lang", stretch)
    learned = own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select("lang")
    own = own.join(F.broadcast(learned), "lang", "left_semi").select("doc_id", "lang", "text")
    rows = sample(own, "lang", "doc_id", SAMPLE_ROWS).orderBy("lang", F.xxhash64("doc_id"), "doc_id", "text").collect()
    parts: dict[str, list[bytes]] = {}
    for r in rows:
        if words := letters_of(r.text):
            parts.setdefault(r.lang, []).append(words[:ROW_BYTES])
    return {lang: b" ".join(p) for lang, p in sorted(parts.items())}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], narrow: float = NARROW, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The language of every whole text.

    Returns ``keep`` and ``lang_pred``, ``score`` (0 to 1: the best language's weight when each
    byte more than the smallest size halves a language's), ``rejected``.

    Defined cases: null texts, texts without a letter and an untrained model give ``und``,
    score 0, rejected; equal sizes go to the first language by name and are rejected; an
    empty table gives no rows; further columns are ignored.
    """
    return map_texts(docs, _identifier(dictionaries, narrow), {"lang_pred": "string", "score": "double", "rejected": "boolean"}, keep)


def _identifier(dictionaries: dict[str, bytes], narrow: float):
    def make():
        coders = {lang: compressor(d, LEVEL, WINDOW) for lang, d in dictionaries.items()}

        def one(text):
            data = letters_of(text)
            if not data or not coders:
                return UNDETERMINED, 0.0, True
            windows = [data[k : k + WINDOW] for k in range(0, len(data), WINDOW)]
            if len(windows[-1]) < len(FILLER):
                windows[-1] += FILLER
            sizes = sorted((sum(len(c.compress(w)) for w in windows), lang) for lang, c in coders.items())
            least = sizes[0][0]
            score = 1 / sum(math.exp(-math.log(2) * min(500, s - least)) for s, _ in sizes)
            margin = (sizes[1][0] - least) / least if len(sizes) > 1 else 1.0
            return sizes[0][1], score, margin < narrow

        def use(texts):
            got = [one(t) for t in texts]
            return {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "rejected": [g[2] for g in got]}

        return use

    return make


def identified(docs: DataFrame, dictionaries: dict[str, bytes], narrow: float = NARROW) -> DataFrame:
    """``docs`` without the rows that language identification rejects; all columns as they are."""
    make = _identifier(dictionaries, narrow)

    def rejected():
        use = make()
        return lambda texts: use(texts)["rejected"]

    small_batches(docs)
    return docs.where(~text_flag(rejected)(F.col("text").cast("string")))


def held_out(column: str = "doc_id", folds: int = 4, fold: int = 2):
    """Whether crc32 of the id as text leaves ``fold``; a null id isn't held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(folds)) == fold, F.lit(False))


def trained_on(docs: DataFrame) -> dict[str, bytes]:
    return train_languages(docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang").where(~held_out()))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, trained_on(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
