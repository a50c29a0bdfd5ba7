"""Benchmark decontamination under edit distance.

The CGK embedding walks along a sequence of words, at each step writing the word it stands on
and moving on or staying by a random bit of that word and step.  Sequences a few edits apart
mostly write the same words at the same steps, so edit distance becomes Hamming distance and
bit sampling (the words at a few steps) is a locality-sensitive hash for it.  Item-sized
windows of each document are hashed so; what shares a hash with an item is verified by exact
edit distance.

The walks part for ever longer after each edit, so that long items would need ever more of them.  An
item of more than ``PIECE`` words is therefore cut in pieces: of an item with at most k edits, one
piece has no more than its share of them (were all above it, they would add up to more than k).
Pieces are looked for, with as many walks as a piece of that length at its bound needs for the
target recall, and around a piece the whole item is verified.  Where no edit is allowed the words
are looked up as they are.

A window within k edits of a piece of L words shares L // (k + 1) words in a row with it, so
windows that hold no such run of any piece are left out; that loses nothing.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.llm.common import table
from briefloom.llm.ngram_join import words_of
from briefloom.llm.texts import map_texts, small_batches, text_flag

#: Edits allowed as a share of an item's words, recall of a piece at its bound, words of a piece at most.
EDIT_SHARE, RECALL, PIECE = 0.15, 0.98, 40
#: Steps of a walk a word: few walks are past the window's end by then, where all windows look alike.
STEPS = 1.5
#: Steps sampled for a hash, hashes a walk, walks at most (the target is reached long before), simulated pieces.
SAMPLED, HASHES, WALKS, TRIALS = 3, 4, 64, 300
#: Words of the items of one pass over the documents: a block is broadcast, and takes about 35 bytes a word (70 MB).
BLOCK_WORDS = 2_000_000
#: Windows embedded at once.
BLOCK_WINDOWS = 20_000
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Scripts written without spaces: each character is a unit of its own.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def units_of(text: str | None) -> list[str]:
    """Words as in the n-gram join; characters of unspaced scripts are words of their own."""
    return words_of(UNSPACED.sub(r" \g<0> ", text) if text and UNSPACED.search(text) else text)


def edits_allowed(n_words: int, share: float = EDIT_SHARE) -> int:
    return int(share * n_words)


def edit_search(item: list[int], text: list[int]) -> tuple[int, int]:
    """(least edits, end) of ``item`` against any stretch of ``text``, by bit-parallel columns; the first end on ties."""
    masks: dict[int, int] = {}
    for k, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << k
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for at, w in enumerate(text):
        eq = masks.get(w, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        ph = down | ~(x | up) & full
        mh = up & x
        score += bool(ph & top) - bool(mh & top)
        ph = ph << 1 & full
        mh = mh << 1 & full
        up = mh | ~((eq | down) | ph) & full
        down = ph & (eq | down)
        if score < best:
            best, end = score, at + 1
    return best, end


def _random_bits() -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers by walk and step, sampled places by walk and hash."""
    r = np.random.RandomState(7)
    odd = r.randint(0, 2**62, (WALKS, int(STEPS * PIECE))).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, np.sort(r.random_sample((WALKS, HASHES, SAMPLED)), axis=2)


ODD, PLACES = _random_bits()


def walk_along(data: np.ndarray, starts: np.ndarray, walk: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Words written at each step, and words gone by then."""
    wrote, went = np.empty((steps, len(starts)), np.int32), np.empty((steps, len(starts)), np.int32)
    at, mixed = starts.copy(), data.astype(np.uint64) * MIX + np.uint64(walk)
    mixed ^= mixed >> np.uint64(29)
    for j in range(steps):
        wrote[j], went[j] = data[at], at - starts
        at += (mixed[at] * ODD[walk, j] >> np.uint64(63)).astype(np.int64)
    return wrote, went


def sampled_key(wrote: np.ndarray, went: np.ndarray, length: int, walk: int, h: int) -> np.ndarray:
    """Hash of the words at the sampled steps, 32 bits (what shares one is verified); past the window's end there is no word."""
    key = np.zeros(wrote.shape[1], np.uint64)
    for u in PLACES[walk, h]:
        j = int(u * int(STEPS * length))
        key = (key + np.where(went[j] < length, wrote[j], -1).astype(np.uint64)) * MIX
        key ^= key >> np.uint64(32)
    return key.astype(np.uint32)


@functools.lru_cache(4096)
def walks_needed(length: int, edits: int, recall: float = RECALL) -> int:
    """Walks that find ``recall`` of random pieces with exactly ``edits`` random edits, where the window starts with the piece."""
    r = np.random.RandomState(1000 * length + edits)
    size = 4 * length
    pieces = r.randint(1, 2**30, (TRIALS, length))
    texts = np.zeros((TRIALS, size), np.int64)
    for k in range(TRIALS):
        words = pieces[k].tolist()
        for _ in range(edits):
            at, kind = r.randint(len(words)) if words else 0, r.randint(3)
            if kind < 2 and words:
                del words[at]
            if kind > 0:
                words.insert(at, int(r.randint(2**30, 2**31)))
        words = words[:size] + r.randint(2**30, 2**31, size).tolist()
        texts[k] = words[:size]
    found = np.zeros(TRIALS, bool)
    own = np.concatenate([pieces, np.zeros((TRIALS, size - length), np.int64)], axis=1)
    starts = np.arange(TRIALS) * size
    data = np.concatenate([own.ravel(), texts.ravel()]).astype(np.int64)
    for walk in range(WALKS):
        wrote, went = walk_along(data, np.concatenate([starts, starts + own.size]), walk, int(STEPS * length))
        for h in range(HASHES):
            key = sampled_key(wrote, went, length, walk, h)
            found |= key[:TRIALS] == key[TRIALS:]
        if found.mean() >= recall:
            return walk + 1
    return WALKS


def runs_of(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    key = np.zeros(count, np.uint64)
    for k in range(n):
        key = key * MIX + words[k : k + count].astype(np.uint64) + np.uint64(1)
    return key ^ key >> np.uint64(31)


class Items:
    """Hashes of a block of benchmark items' pieces, and the search for the items.  Made once, broadcast to the workers."""

    def __init__(self, items: list[tuple[int, list[str]]], share: float = EDIT_SHARE, recall: float = RECALL):
        items = [(i, w) for i, w in items if w]
        self.ids = [i for i, _ in items]
        self.number: dict[str, int] = {}
        for _, words in items:
            for w in words:
                self.number.setdefault(w, len(self.number) + 1)
        self.words = [np.array([self.number[w] for w in words], np.int64) for _, words in items]
        self.allowed = [edits_allowed(len(w), share) for w in self.words]
        #: (item, first word, words, edits) of each piece
        self.pieces: list[tuple[int, int, np.ndarray, int]] = []
        near: dict[int, list[int]] = {}
        exact: dict[int, list[int]] = {}
        for k, (words, edits) in enumerate(zip(self.words, self.allowed)):
            cuts = np.linspace(0, len(words), math.ceil(len(words) / PIECE) + 1).astype(int)
            for lo, hi in zip(cuts, cuts[1:]):
                own = edits * int(hi - lo) // len(words)
                (near if own else exact).setdefault(int(hi - lo), []).append(len(self.pieces))
                self.pieces.append((k, int(lo), words[lo:hi], own))
        self.longest = max(near, default=0)
        self.run = min((n // (self.pieces[p][3] + 1) for n, ps in near.items() for p in ps), default=1)
        self.runs = np.unique(np.concatenate([runs_of(self.pieces[p][2], self.run) for ps in near.values() for p in ps] or [np.empty(0, np.uint64)]))
        #: by length, walk and hash: sorted keys and their pieces
        self.tables: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.walks: dict[int, int] = {}
        for length, own in near.items():
            data = np.concatenate([self.pieces[p][2] for p in own] + [np.zeros(2 * PIECE, np.int64)])
            starts = np.arange(len(own)) * length
            self.walks[length] = max(walks_needed(length, e, recall) for e in {self.pieces[p][3] for p in own})
            for walk in range(self.walks[length]):
                wrote, went = walk_along(data, starts, walk, int(STEPS * length))
                for h in range(HASHES):
                    keys = sampled_key(wrote, went, length, walk, h)
                    order = np.argsort(keys, kind="stable")
                    self.tables[length, walk, h] = keys[order], np.array(own, np.int32)[order]
        #: by length: sorted hashes of whole pieces that must stand as they are
        self.exact: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length, own in exact.items():
            keys = np.concatenate([runs_of(self.pieces[p][2], length) for p in own])
            order = np.argsort(keys, kind="stable")
            self.exact[length] = keys[order], np.array(own, np.int32)[order]

    def numbered(self, words: list[str]) -> np.ndarray:
        get = self.number.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    def windows(self, data: np.ndarray) -> np.ndarray:
        """Starts of windows that hold a run of some piece."""
        keys = runs_of(data, self.run)
        if not len(keys) or not len(self.runs):
            return np.empty(0, np.int64)
        found = np.searchsorted(self.runs, keys)
        found[found == len(self.runs)] = 0
        hits = np.flatnonzero(self.runs[found] == keys)
        if not len(hits):
            return hits
        # starts from (hit - longest + run) to hit
        edge = np.zeros(len(data) + 1, np.int64)
        np.add.at(edge, np.maximum(0, hits - self.longest + self.run), 1)
        np.add.at(edge, hits + 1, -1)
        return np.flatnonzero(np.cumsum(edge[:-1]) > 0)

    def candidates(self, data: np.ndarray, starts: np.ndarray) -> set[tuple[int, int]]:
        """(start, piece) pairs that share a hash."""
        found: set[tuple[int, int]] = set()
        for walk in range(max(self.walks.values(), default=0)):
            lengths = [n for n, most in self.walks.items() if walk < most]
            wrote, went = walk_along(data, starts, walk, int(STEPS * max(lengths)))
            for length in lengths:
                for h in range(HASHES):
                    keys = sampled_key(wrote, went, length, walk, h)
                    _paired(*self.tables[length, walk, h], keys, starts, found)
        return found

    def as_they_are(self, data: np.ndarray) -> set[tuple[int, int]]:
        """(start, piece) pairs of pieces that stand in ``data`` without an edit, but for hash collisions."""
        found: set[tuple[int, int]] = set()
        for length, (table_, own) in self.exact.items():
            keys = runs_of(data, length)
            _paired(table_, own, keys, np.arange(len(keys)), found)
        return found

    def search(self, texts: list[str | None], any_item: bool = False) -> list[list[int]]:
        """For each text, flat (item id, edits, first word) of the items found, one for each item; with ``any_item`` no further ones are looked for."""
        self.any_item, self.hit = any_item, set()
        docs = [self.numbered(units_of(t)) for t in texts]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        done: set[tuple[int, int, int]] = set()
        for k, data in enumerate(docs):
            for start, piece in sorted(self.as_they_are(data)) if self.exact else ():
                self._verify(k, data, start, piece, best, done)
        starts = [self.windows(d) for d in docs]
        some = [k for k, s in enumerate(starts) if len(s)]
        gap = np.zeros(self.longest + 1, np.int64)
        at = 0
        while at < len(some):
            take, size = [], 0
            while at < len(some) and (not take or size + len(starts[some[at]]) <= BLOCK_WINDOWS):
                take.append(some[at])
                size += len(starts[some[at]])
                at += 1
            # a walk goes on for at most its steps beyond the last start
            data = np.concatenate([x for k in take for x in (docs[k], gap)] + [np.zeros(2 * PIECE, np.int64)])
            base = np.cumsum([0] + [len(docs[k]) + len(gap) for k in take])
            all_ = np.concatenate([starts[k] + b for k, b in zip(take, base)])
            for part in range(0, len(all_), BLOCK_WINDOWS):
                for start, piece in sorted(self.candidates(data, all_[part : part + BLOCK_WINDOWS])):
                    n = int(np.searchsorted(base, start, "right")) - 1
                    self._verify(take[n], docs[take[n]], start - int(base[n]), piece, best, done)
        out: list[list[int]] = [[] for _ in texts]
        for (k, item), (edits, first) in sorted(best.items()):
            out[k] += [self.ids[item], edits, first]
        return out

    def _verify(self, k: int, data: np.ndarray, start: int, piece: int, best: dict[tuple[int, int], tuple[int, int]], done: set[tuple[int, int, int]]) -> None:
        """Edit distance of the piece and then of its whole item about there; ``best`` by text and item, ``done`` the stretches looked at."""
        if self.any_item and k in self.hit:
            return
        item, first, words, own = self.pieces[piece]
        whole, edits = self.words[item], self.allowed[item]
        # finds that put the item's start near the same word share one look
        stride = edits + 1
        near = (start - first) // stride
        if best.get((k, item), (1, 0))[0] == 0 or (k, item, near) in done:
            return
        if len(whole) > len(words):
            low = max(0, start - own)
            if edit_search(words.tolist(), data[low : start + len(words) + own].tolist())[0] > own:
                return
        done.add((k, item, near))
        low = max(0, near * stride - 2 * edits)
        got, end = edit_search(whole.tolist(), data[low : max(0, (near + 1) * stride + len(whole) + 2 * edits)].tolist())
        if got <= edits and ((k, item) not in best or got < best[k, item][0]):
            best[k, item] = got, max(0, low + end - len(whole))
            self.hit.add(k)


def _paired(table_: np.ndarray, own: np.ndarray, keys: np.ndarray, starts: np.ndarray, found: set[tuple[int, int]]) -> None:
    """Add (start, piece) for keys that stand in the sorted ``table_``."""
    lo, hi = np.searchsorted(table_, keys, "left"), np.searchsorted(table_, keys, "right")
    for k in np.flatnonzero(hi > lo):
        found.update((int(starts[k]), int(p)) for p in own[lo[k] : hi[k]])


def item_blocks(benchmark: DataFrame, block: int = BLOCK_WORDS) -> Iterator[list[tuple[int, list[str]]]]:
    """Items by blocks of at most ``block`` words, an item of more alone; null ids and texts are left out.

    The driver holds the items of one bucket, of about half a block, at a time.
    """
    own = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    spaced = F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    unspaced = F.length("text") - F.length(F.regexp_replace("text", UNSPACED.pattern, ""))
    buckets = max(1, math.ceil(2 * (own.agg(F.sum(spaced + unspaced)).first()[0] or 0) / block))
    for k in range(buckets):
        held, size = [], 0
        for r in own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(buckets)) == k).orderBy("item_id", "text").collect():
            words = units_of(r.text)
            if held and size + len(words) > block:
                yield held
                held, size = [], 0
            held.append((r.item_id, words))
            size += len(words)
        if held or not k:
            yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE) -> DataFrame:
    """Benchmark items inside documents: ``doc_id``, ``item_id``, ``edits``, ``first_word``, ``n_words`` of the item.

    A row for each document and item that stands in it with at most ``share`` of the item's
    words edited (inserted, deleted or replaced), at its best place.

    Defined cases: null or empty texts, null items and items without a word match nothing; items
    too short for an edit (fewer than 7 words at 15 %) must stand as they are; null and repeated
    doc_ids are carried; empty tables give no rows; further columns are ignored.
    """
    out = None
    for items in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Items(items, share))

        def make(shared=shared):
            search = shared.value.search
            return lambda texts: {"__found": search(texts)}

        found = map_texts(docs, make, {"__found": "array<long>"}).where(F.size("__found") > 0)
        triple = F.explode(F.transform(F.sequence(F.lit(0), F.size("__found") - 3, F.lit(3)), lambda k: F.slice("__found", k + 1, 3)))
        rows = found.select("doc_id", triple.alias("m")).select(
            "doc_id", F.col("m")[0].alias("item_id"), F.col("m")[1].cast("int").alias("edits"), F.col("m")[2].alias("first_word")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE) -> DataFrame:
    """``docs`` without the documents in which a benchmark item stands; all columns as they are."""
    small_batches(docs)
    for items in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Items(items, share))

        def make(shared=shared):
            search = shared.value.search
            return lambda texts: [x for k in range(0, len(texts), 1024) for x in search(texts[k : k + 1024], any_item=True)]

        docs = docs.where(~text_flag(make)(F.col("text").cast("string")))
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
