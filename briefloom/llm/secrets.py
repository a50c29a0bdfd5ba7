"""Secret scans in DataFrame expressions only.

Three fixed shapes (assignments, access keys, hex strings) and, beside them, strings whose
Shannon entropy within a sliding window is high for their character class.  The window's
entropy comes from counts kept up to date as it slides: one character is added, one removed.
Strings that match the allow-list are let go.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.llm.common import table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
#: Candidate strings: whole runs of these characters.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}"
#: (class, its characters, window, least bits a character); the first class that fits counts.
CLASSES = (("hex", "[0-9a-fA-F]+", 32, 3.0), ("base64", "[A-Za-z0-9+/_=-]+", 24, 3.9))
#: No secrets: placeholders, hyphenated or snake-case words, paths of words, UUIDs.  Repeated groups are possessive: Java
#: tries others by recursion, as deep as there are repetitions.
ALLOWED = (
    "(?i)(example|placeholder|changeme|dummy|redacted|lorem|xxxx|0123456789|abcdefgh)",
    "^[A-Za-z]*+(?:[-_/=+][A-Za-z]++)*+[-_/=+]*+[0-9]{0,4}$",
    "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
)
SPAN = "array<struct<start:int,end:int,hit:string>>"
#: Items that are accumulated at once, and code points of a piece of a text that is cut.
CHUNK, PIECE = 64, 4096


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once a row."""
    return F.transform(F.array(value), use)[0]


def with_prefix(items: Column, value, op, zero: Column) -> Column:
    """Array of (item, before): ``before`` is ``op`` over the values of all earlier items.

    A fold that appends copies its array at every item, so more than a chunk of items go in
    chunks: each chunk's total, then the totals before each chunk, then the items of a chunk
    from there.  Work is linear but for an array of one number a chunk.
    """
    fold = lambda xs, start: F.aggregate(xs, start, lambda acc, x: op(acc, value(x)))

    def appended(xs: Column, start: Column, own, more) -> Column:
        """For each of ``xs`` what ``own`` makes of it and the accumulated value before it."""
        first = F.slice(F.transform(xs, lambda x: own(x, start)), 1, 0)  # an empty array of the right type
        zero_ = F.struct(start.alias("at"), first.alias("out"))
        step = lambda acc, x: F.struct(op(acc["at"], more(x)).alias("at"), F.concat(acc["out"], F.array(own(x, acc["at"]))).alias("out"))
        return F.aggregate(xs, zero_, step, lambda acc: acc["out"])

    laid = lambda c, at: appended(c, at, lambda x, before: F.struct(x.alias("item"), before.alias("before")), value)

    def by_chunk(chunks: Column) -> Column:
        starts = appended(F.transform(chunks, lambda c: fold(c, zero)), zero, lambda _, at: at, lambda total: total)
        return F.flatten(F.zip_with(chunks, starts, laid))

    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(CHUNK)), lambda k: F.slice(items, k + 1, CHUNK))
    return F.when(F.size(items) <= CHUNK, laid(items, zero)).otherwise(_bound(chunks, by_chunk))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, hit), in code points."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(
        F.split(text, pattern, -1), hits, lambda gap, hit: F.when(hit.isNotNull(), F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    )

    def laid(parts: Column) -> Column:
        placed = with_prefix(parts, lambda x: x["gap"] + F.length(x["hit"]), lambda a, b: a + b, F.lit(0))
        start = lambda p: p["before"] + p["item"]["gap"]
        return F.transform(
            placed, lambda p: F.struct(start(p).alias("start"), (start(p) + F.length(p["item"]["hit"])).alias("end"), p["item"]["hit"].alias("hit"))
        )

    found = _bound(F.filter(pairs, lambda x: x.isNotNull()), laid)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def peak_entropy(text: Column, window: int, enough: float = math.inf) -> Column:
    """Greatest entropy, in bits a character, of ``window`` consecutive characters of an ASCII string.

    A step looks up how often the character that comes and the one that goes stand in the window,
    and corrects the sum for these two.  From the first window with ``enough`` bits on nothing is
    worked out any more, and that window's entropy is the result.
    """

    def plogp(c: Column) -> Column:
        return F.when(c <= 1, F.lit(0.0)).otherwise(c * F.log2(c.cast("double")))

    def slide(codes: Column) -> Column:
        def step(acc, i):
            new, old = codes[i], F.when(i >= window, codes[i - window])
            seen = F.slice(codes, F.greatest(i - window, F.lit(0)) + 1, F.least(i, F.lit(window)))

            def corrected(w: Column) -> Column:
                count = lambda c: F.size(F.filter(w, lambda x: x == c))
                more = _bound(count(new), lambda n: plogp(n + 1) - plogp(n))
                less = F.when(old.isNull(), 0.0).otherwise(_bound(count(old), lambda n: plogp(n - 1) - plogp(n)))
                return acc["s"] + F.when(old == new, 0.0).otherwise(more + less)

            def next_(s: Column) -> Column:
                bits = F.log2(F.lit(float(window))) - s / window
                return F.struct(s.alias("s"), F.when(i >= window - 1, F.greatest(acc["best"], bits)).otherwise(acc["best"]).alias("best"))

            return F.when(acc["best"] >= enough, acc).otherwise(_bound(_bound(seen, corrected), next_))

        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, step, lambda acc: acc["best"])

    return F.when(F.length(text) >= window, _bound(F.transform(F.split(text, ""), F.ascii), slide)).otherwise(0.0)


def is_secret(hit: Column, classes=CLASSES, allowed=ALLOWED) -> Column:
    """Whether a candidate string's windowed entropy is high for its class and no allow-list pattern fits."""
    high = F.lit(False)
    for _, chars, window, bits in reversed(classes):
        high = F.when(hit.rlike(f"^{chars}$"), peak_entropy(hit, window, bits) >= bits).otherwise(high)
    mixed = hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")
    let_go = F.lit(False)
    for a in allowed:
        let_go = let_go | hit.rlike(a)
    return F.when(mixed & ~let_go, high).otherwise(False)


def with_secrets(docs: DataFrame, classes=CLASSES, allowed=ALLOWED, name: str = "found") -> DataFrame:
    """``docs`` and a column ``name``: array of (start, order, end, kind), sorted.

    Kinds in order: assign, access, hex, entropy; an entropy span inside another isn't given.

    Defined cases: a null or empty text has no spans; null ids, repeated rows and further
    columns are carried (one called ``name`` is replaced); an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    assign = F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["hit"], ASSIGN, 2)) >= 8)
    access = F.filter(matches(text, ACCESS), lambda m: F.length(m["hit"]) >= 16)
    hexes = matches(text, HEX)
    entropy = F.filter(matches(text, CANDIDATE), lambda m: is_secret(m["hit"], classes, allowed))

    def named(spans: Column, order: int, kind: str) -> Column:
        return F.transform(
            spans, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end"), F.lit(kind).alias("kind"))
        )

    base = F.concat(named(assign, 0, "assign"), named(access, 1, "access"), named(hexes, 2, "hex"))
    # in order of start (fixed kinds first), a span lies in a fixed one if those before it reach its end
    reach = lambda s: F.when(s["order"] < 3, s["end"]).otherwise(F.lit(0))
    placed = _bound(F.array_sort(F.concat(base, named(entropy, 3, "entropy"))), lambda spans: with_prefix(spans, reach, F.greatest, F.lit(0)))
    both = F.transform(F.filter(placed, lambda p: (p["item"]["order"] < 3) | (p["before"] < p["item"]["end"])), lambda p: p["item"])
    return docs.withColumn(name, both)


def redacted(docs: DataFrame, mark: str = "[SECRET]", classes=CLASSES, allowed=ALLOWED) -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark`` and ``n_chars``, if there, counted anew.

    Overlapping spans become one mark.  Texts without spans, null ones included, stay as they are.
    """
    spans = "__spans"
    found = with_secrets(docs, classes, allowed, spans)

    def cut(x: Column) -> Column:
        """Text between spans, by pieces, so that no place is counted from the text's start."""

        def between(pieces: Column, low: Column, high: Column) -> Column:
            part = lambda k: F.substring(
                pieces[k], F.greatest(low - k * PIECE, F.lit(0)) + 1, F.least(high - k * PIECE, F.lit(PIECE)) - F.greatest(low - k * PIECE, F.lit(0))
            )
            whole = F.array_join(F.transform(F.sequence(F.floor(low / PIECE).cast("int"), F.floor((high - 1) / PIECE).cast("int")), part), "")
            return F.when(high > low, whole).otherwise("")

        def joined(b: Column) -> Column:
            fresh = F.filter(b["placed"], lambda p: p["item"]["start"] >= p["before"])
            marked = F.transform(fresh, lambda p: F.concat(between(b["pieces"], p["before"], p["item"]["start"]), F.lit(mark)))
            end = F.array_max(F.transform(b["placed"], lambda p: p["item"]["end"]))
            return F.concat(F.array_join(marked, ""), between(b["pieces"], end, F.length("text")))

        pieces = F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
        placed = with_prefix(x, lambda s: s["end"], F.greatest, F.lit(0))
        return _bound(F.struct(placed.alias("placed"), pieces.alias("pieces")), joined)

    out = found.withColumn("text", F.when(F.size(spans) > 0, _bound(F.col(spans), cut)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def scan_secrets(docs: DataFrame, classes=CLASSES, allowed=ALLOWED) -> DataFrame:
    """One row per document: ``doc_id``, counts of the fixed kinds, a digest of their spans, all spans as text."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    found = with_secrets(docs.select("doc_id", "text"), classes, allowed).select("doc_id", "found")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(joined(F.filter("found", lambda s: s["order"] < 3)), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
