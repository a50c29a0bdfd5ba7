"""Sequence packing as a cutting-stock problem solved by column generation.

Documents are tokenized once; what is kept of them is their length and a checksum at every
``UNIT`` tokens.  Whole sequences are cut off long documents; what remains of each document
is an item whose length is counted in units.  The histogram of item lengths (as many bins as
a sequence has units, whatever the input) goes to the driver, where a linear program over
packing patterns is solved: a knapsack dynamic program prices new patterns until none helps.
Patterns are rounded down and dealt to the documents by their rank within their length.  What
rounding leaves over, and lengths that only wasteful patterns would hold, is laid end to end
and cut at sequence ends.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import json
import os
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from briefloom.llm.common import table, written
from briefloom.llm.texts import map_texts

#: Tokens of a unit of length; documents are cut at whole units only.
UNIT = 8
#: Rows of (task, length) counts up to which they are broadcast.
BROADCAST_ROWS = 500_000
#: Strings that a Python worker remembers, and marks that often end one.
STRINGS_KEPT, END_MARKS = 300_000, ".,!?;:"

WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")

SPACE = regex.compile(r"\p{White_Space}+")
SEPARATOR = regex.compile(r"[\x1c-\x1f]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of a text by its strings between white space: known ones are looked up, the library encodes new words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        #: The library's merges, for words that are normalized and cut already.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.ends = np.zeros(self.plain.get_vocab_size(), bool)  # tokens that end a word
        self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(spec["model"]["end_of_word_suffix"])]] = True
        self.known: dict[str, bytes] = {}
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        self._encode(list(END_MARKS))
        self.marks = {m: self.known[m] for m in END_MARKS}

    def _encode(self, words: list[str]) -> None:
        some = [words[k : k + 256] for k in range(0, len(words), 256)]
        for part, e in zip(some, self.plain.encode_batch_fast([" ".join(p) for p in some], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("the vocabulary doesn't mark where words end")
            data, at = ids.tobytes(), 0
            for w, end in zip(part, (ends * 4).tolist()):
                self.known[w] = data[at:end]
                at = end

    def _learn(self, strings: set[str]) -> None:
        """Strings of letters are words, most others are words with a mark after them; the rest is cut by the pattern."""
        known, marked, rest = self.known, [], []
        words = set()
        for s in strings:
            if s.isalpha():
                words.add(s)
            elif s[-1:] in self.marks and s[:-1].isalpha():
                marked.append(s)
                words.add(s[:-1])
            else:
                ws = WORD.findall(s)
                rest.append((s, ws))
                words.update(ws)
        if new := list(words.difference(known)):
            self._encode(new)
        for s in marked:
            known[s] = known[s[:-1]] + self.marks[s[-1]]
        for s, ws in rest:
            known[s] = b"".join([known[w] for w in ws])

    def _parts(self, text: str) -> list:
        """Lists of strings between white space, and ids of special tokens in the text."""
        out = []
        for k, part in enumerate(self.split.split(text) if self.split and "<|" in text else [text]):
            if k % 2:
                out.append(self.added[part].to_bytes(4, "little"))
                continue
            if not part.isascii() and not unicodedata.is_normalized("NFC", part):
                part = unicodedata.normalize("NFC", part)
            if "Σ" in part:  # the library lower-cases letter by letter
                part = part.replace("Σ", "σ")
            # split() also takes the separators \x1c to \x1f for white space; the tokenizer doesn't
            out.append(SPACE.split(part.lower()) if SEPARATOR.search(part) else part.lower().split())
        return out

    def many(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        parts = [self._parts(t) for t in texts]
        lists = [x for p in parts for x in p if type(x) is list]
        if new := set().union(*lists).difference(self.known):
            if len(self.known) + len(new) > STRINGS_KEPT:
                # the oldest half stays: common words come early
                self.known = dict(itertools.islice(self.known.items(), STRINGS_KEPT // 2))
                new = set().union(*lists).difference(self.known)
            self._learn(new)
        get = self.known.__getitem__
        return [b"".join([x if type(x) is bytes else b"".join(map(get, x)) for x in p]) for p in parts]

    def ids(self, text: str) -> bytes:
        return self.many([text])[0]


@functools.lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def tokenized(docs: DataFrame, size: int, end_id: int, path: str) -> DataFrame:
    """A row a document: length, checksums at every unit, and the document's rank in its task.

    ``bin`` is the length in units of what remains beyond whole sequences, ``rank`` counts the
    task's rows of that bin and ``whole_before`` its whole sequences so far.
    """

    def make():
        from pyspark import TaskContext

        part, enc, end, width = TaskContext.get().partitionId(), encoder(path), end_id.to_bytes(4, "little"), 4 * UNIT
        ranks, before, crc32 = Counter(), [0], zlib.crc32

        def one(ids):
            data = ids + end
            n, crc, marks = len(data) // 4, 0, []
            for at in range(0, len(data), width):
                crc = crc32(data[at : at + width], crc)
                marks.append(crc)
            b = -(-(n % size) // UNIT)
            row = n, np.array(marks, "<u4").tobytes(), part, b, ranks[b], before[0]
            ranks[b] += 1
            before[0] += n // size
            return row

        def use(texts):
            texts = [t or "" for t in texts]
            rows = [one(x) for k in range(0, len(texts), 64) for x in enc.many(texts[k : k + 64])]
            return dict(zip(new, zip(*rows))) if rows else {k: [] for k in new}

        return use

    new = {"doc_tokens": "long", "marks": "binary", "part": "int", "bin": "int", "rank": "long", "whole_before": "long"}
    return map_texts(docs, make, new)


def knapsack(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best value of items (item k has length k + 1, any number of each) within ``capacity``; how many of each."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    for c in range(1, capacity + 1):
        m = min(c, len(values))
        got = best[c - 1 :: -1][:m] + values[:m]
        k = int(got.argmax())
        if got[k] > best[c - 1] + 1e-12:
            best[c], choice[c] = got[k], k + 1
        else:
            best[c] = best[c - 1]
    used, c = np.zeros(len(values), int), capacity
    while c > 0:
        if choice[c]:
            used[choice[c] - 1] += 1
            c -= choice[c]
        else:
            c -= 1
    return best[capacity], used


def _first_patterns(lengths: np.ndarray, need: np.ndarray, capacity: int) -> tuple[list[np.ndarray], np.ndarray, list[int]]:
    """A basic feasible solution: each pattern is used until it has used up a length, which no later one has."""
    left, basis, x, order = need.copy(), [None] * len(lengths), np.zeros(len(lengths)), []
    while (left > 0).any():
        k = int(np.flatnonzero(left > 0)[-1])
        values = np.zeros(int(lengths[-1]))
        values[lengths - 1] = np.where(left > 0, lengths * (1 + 1e-4 * lengths), 0)
        pattern = np.eye(len(lengths), dtype=int)[k]
        if capacity > lengths[k]:
            pattern = pattern + knapsack(values, capacity - int(lengths[k]))[1][lengths - 1]
        often = np.where(pattern > 0, left / np.maximum(pattern, 1), np.inf)
        out = int(often.argmin())
        before = left > 0
        left = left - often[out] * pattern
        left[before & (left < 1e-9)] = 1e-9  # used up by the way: its own pattern comes later
        left[out], basis[out], x[out] = 0, pattern, often[out]
        order.append(out)
    return basis, x, order


def _replace(inverse: np.ndarray, step: np.ndarray, out: int) -> None:
    """Put the column whose product with ``inverse`` is ``step`` in place ``out`` of the basis."""
    row = inverse[out] / step[out]
    inverse -= np.outer(step, row)
    inverse[out] = row


def column_generation(
    histogram: np.ndarray, capacity: int, gap: float = 0.002, rounds: int = 4000, weight: float = 0.85
) -> list[tuple[int, np.ndarray]]:
    """Patterns and how often each is used, fractions rounded down.

    ``histogram[k]`` items have length k + 1.  Least sequences that hold them all, as a linear
    program: a revised simplex over patterns, which the knapsack prices with the duals.  The
    prices lean by ``weight`` on the duals of the best bound so far (at first each length's
    share of a sequence), which keeps them from swinging.  It ends when the sequences used are
    within ``gap`` of that bound.
    """
    kinds = np.flatnonzero(histogram)
    if not len(kinds):
        return []
    need = histogram[kinds].astype(float)
    basis, x, order = _first_patterns(kinds + 1, need, capacity)
    inverse = np.eye(len(kinds))  # of the basis, a triangle in the order in which lengths were used up
    for k in order:
        _replace(inverse, inverse @ basis[k], k)
    center = (kinds + 1) / capacity
    bound = need @ center
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        if x.sum() <= bound * (1 + gap):
            break
        lean, column = weight, None
        while True:
            price = lean * center + (1 - lean) * np.maximum(duals, 0)
            values = np.zeros(int(kinds[-1]) + 1)
            values[kinds] = price
            best, used = knapsack(values, capacity)
            if need @ price / best > bound:
                bound, center = need @ price / best, price / best
            if used[kinds] @ duals > 1 + 1e-7:
                column = used[kinds]
                break
            if lean == 0:
                break
            lean = lean / 2 if lean > 0.2 else 0
        if column is None:
            break
        step = inverse @ column
        able = step > 1e-9
        ratio = np.where(able, x / np.where(able, step, 1), np.inf)
        out = int(ratio.argmin())
        t = ratio[out]
        x = np.maximum(x - t * step, 0)
        x[out] = t
        basis[out] = column
        _replace(inverse, step, out)
    whole = []
    for pattern, often in zip(basis, np.floor(x + 1e-6).astype(int)):
        full = np.zeros(len(histogram), int)
        full[kinds] = pattern
        if often > 0:
            whole.append((int(often), full))
    return whole


def pattern_plan(histogram: np.ndarray, capacity: int, waste: int = 1) -> tuple[pd.DataFrame, np.ndarray, int]:
    """(slices of ranks, items placed by length, sequences used).

    Each slice says: items of length ``bin`` ranked ``lo`` to ``hi`` go, ``per`` to a sequence,
    to sequences from ``base`` on, from place ``slot`` on.  Patterns that leave more than
    ``waste`` units free aren't used.
    """
    placed, base, rows = np.zeros(len(histogram), np.int64), 0, []
    for often, pattern in column_generation(histogram, capacity):
        if capacity - int(pattern @ np.arange(1, len(pattern) + 1)) > waste:
            continue
        room = [int((histogram[k] - placed[k]) // pattern[k]) for k in np.flatnonzero(pattern)]
        often = min(often, *room)
        if often <= 0:
            continue
        slot = 0
        for k in np.flatnonzero(pattern):
            take = often * int(pattern[k])
            rows.append((int(k) + 1, int(placed[k]), int(placed[k]) + take, int(pattern[k]), base, slot))
            placed[k] += take
            slot += int(pattern[k])
        base += often
    return pd.DataFrame(rows, columns=["bin", "lo", "hi", "per", "base", "slot"]), placed, base


def _shift_tables(bits: int) -> np.ndarray:
    """What 4 * 2**k zero bytes do to a CRC-32, by bit of it."""
    zero = np.array([zlib.crc32(b"\0" * 4, 1 << i ^ 0) ^ zlib.crc32(b"\0" * 4, 0) for i in range(32)], np.uint32)
    tables = [zero]
    for _ in range(bits - 1):
        tables.append(_apply(tables[-1], tables[-1]))
    return np.array(tables)


def _apply(table_: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = np.zeros_like(v)
    for i in range(32):
        out ^= np.where(v >> np.uint32(i) & np.uint32(1), table_[i], np.uint32(0))
    return out


def piece_crc(before: np.ndarray, after: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """CRC-32 of ``tokens`` ids between the prefix checksums ``before`` and ``after``."""
    v = before.copy()
    bits = max(1, int(tokens.max(initial=1)).bit_length())
    for k, t in enumerate(_shift_tables(bits)):
        v = np.where(tokens >> k & 1, _apply(t, v), v)
    return v ^ after


def pack(docs: DataFrame, size: int = 2048, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Pack all documents into sequences of at most ``size`` tokens.

    Returns per piece: ``doc_id``, ``start`` (the document's ids before it), ``length``,
    ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` (gapless from 0).  Every id of a
    document, its end id included, lies in exactly one piece.

    Defined cases: a null or empty text is its end id alone; null and repeated doc_ids are
    packed row by row; an empty table gives no rows; further columns are ignored.
    """
    if size % UNIT:
        raise ValueError(f"size must be a multiple of {UNIT}")
    spark, units = docs.sparkSession, size // UNIT
    tokens = written(tokenized(docs, size, end_id, path or default_path()), "tokens")
    # one row a task and length
    counts = written(
        tokens.groupBy("part", "bin").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("doc_tokens") / size)).alias("whole")), "counts"
    )
    histogram = np.zeros(units, np.int64)
    for r in counts.where("bin > 0").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most a row a unit
        histogram[r.bin - 1] = r.n
    slices, placed, base = pattern_plan(histogram, units)
    left = (histogram - placed) * np.arange(1, units + 1)
    streamed = (np.cumsum(left) - left).tolist()  # units laid before each length
    first_whole = base + -(-int(left.sum()) // units)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "bin", F.coalesce(F.sum("n").over(before.partitionBy("bin")), F.lit(0)).alias("before"))
    # a row a task
    tasks = counts.groupBy("part").agg(F.sum("whole").alias("w")).select("part", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("whole_first"))
    offsets = offsets.join(tasks, "part")
    if counts.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    placed = placed.tolist()
    ranked = tokens.join(offsets, ["part", "bin"]).select(
        F.col("doc_id").cast("string").alias("doc_id"), "doc_tokens", "marks", "bin", (F.col("before") + F.col("rank")).alias("rank"), (F.col("whole_first") + F.col("whole_before")).alias("whole")
    )
    by_bin = {b: (g["lo"].tolist(), g[["lo", "per", "base", "slot"]].to_numpy().tolist()) for b, g in slices.groupby("bin")}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, steps = [], pdf[["doc_tokens", "bin", "rank", "whole"]].to_numpy().tolist()
            for doc_id, marks, (n, b, rank, whole) in zip(pdf["doc_id"], pdf["marks"], steps):
                full = n // size
                pieces = [(k * size, size, first_whole + whole + k, 0) for k in range(full)]
                at = full * size
                if b and rank < placed[b - 1]:
                    los, runs = by_bin[b]
                    lo, per, first, slot = runs[bisect.bisect_right(los, rank) - 1]
                    pieces.append((at, n - at, first + (rank - lo) // per, slot + (rank - lo) % per))
                elif b:
                    u = streamed[b - 1] + (rank - placed[b - 1]) * b
                    end = u + b
                    while u < end:
                        stop = min(end, (u // units + 1) * units)
                        length = n - at if stop == end else (stop - u) * UNIT
                        pieces.append((at, length, base + u // units, u % units))
                        at, u = at + length, stop
                marks = np.frombuffer(marks, "<u4").tolist()
                for start, length, seq, slot in pieces:
                    before = marks[start // UNIT - 1] if start else 0
                    out.append((doc_id, start, length, before, marks[-(-(start + length) // UNIT) - 1], n, seq, slot))
            got = pd.DataFrame(out, columns=["doc_id", "start", "length", "a", "b", "doc_tokens", "sequence_id", "slot"])
            crc = piece_crc(got["a"].to_numpy(np.uint32), got["b"].to_numpy(np.uint32), got["length"].to_numpy(np.int64))
            yield got.assign(ids_crc32=crc.astype(np.int64)).drop(columns=["a", "b"])

    pieces = ranked.mapInPandas(
        place, "doc_id string, start long, length long, doc_tokens long, sequence_id long, slot long, ids_crc32 long"
    )
    along = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.select(
        F.col("doc_id").cast("long").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(along), F.lit(0)).alias("offset")
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
