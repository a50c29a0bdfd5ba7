"""Token counts by prefix dynamic programming.

For a byte-level BPE the encoding of a word's prefix is the encoding of a shorter prefix and
one more token: the one suffix token that the merges leave apart from the token before it.
So one pass over a word gives its exact token count at every prefix.  A text's words (the
pieces the tokenizer's pattern cuts) are independent, hence counts at all prefixes of a text
are sums of word counts; budgets and truncations read them off without encoding again.
"""

from __future__ import annotations

import functools
import itertools
import json

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.llm.common import table
from briefloom.llm.texts import map_texts

#: The byte-level pattern; white space is Unicode's White_Space.
PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
SPLIT_CONTRACTIONS = ("'re", "'ve", "'ll")
#: Words and token pairs remembered by a Python worker.
WORDS_KEPT, PAIRS_KEPT = 300_000, 400_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Exact token counts at every prefix of a text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        self.merges = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            a, b = raw(a), raw(b)
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.longest = max(map(len, self.vocab))
        self.special = [a["content"] for a in spec["added_tokens"]]
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pairs: dict[int, bool] = {}
        self.size = _Sizes(self)

    def encode(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first; for pairs of tokens, which are short."""
        ids = [self.vocab[data[k : k + 1]] for k in range(len(data))]
        merges, none = self.merges, (1 << 60, 0)
        while len(ids) > 1:
            rank, at, made = min((merges.get((ids[k], ids[k + 1]), none)[0], k, 0) for k in range(len(ids) - 1))
            if rank == none[0]:
                break
            pair, made = (ids[at], ids[at + 1]), merges[ids[at], ids[at + 1]][1]
            out, k = [], 0
            while k < len(ids):
                if k + 1 < len(ids) and (ids[k], ids[k + 1]) == pair:
                    out.append(made)
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def apart(self, a: int, b: int) -> bool:
        """Whether token b can follow token a: their bytes encode to just these two."""
        key = a << 20 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            got = self.pairs[key] = self.encode(self.tokens[a] + self.tokens[b]) == [a, b]
        return got

    def prefixes(self, data: bytes) -> list[int]:
        """Tokens of data[:k] for k = 0 .. len(data)."""
        vocab, pairs, longest = self.vocab, self.pairs, self.longest
        last, count = [0] * (len(data) + 1), [0] * (len(data) + 1)
        for end in range(1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                t = vocab.get(data[start:end])
                if t is None:
                    continue
                if start == 0:
                    # the whole prefix is a token; the merges reach every token of such a vocabulary
                    last[end], count[end] = t, 1
                    break
                ok = pairs.get(last[start] << 20 | t)
                if ok or ok is None and self.apart(last[start], t):
                    last[end], count[end] = t, count[start] + 1
                    break
        return count

    def count(self, text: str) -> int:
        if self.specials is None or self.special[0][:2] not in text:
            return sum(map(self.size.__getitem__, PATTERN.findall(text)))
        parts = self.specials.split(text)
        return sum(map(self.size.__getitem__, [w for p in parts[::2] for w in PATTERN.findall(p)])) + len(parts) // 2

    def text_prefixes(self, text: str) -> np.ndarray:
        """Token counts of text[:k] for k = 0 .. len(text) code points, as uint32."""
        out = np.zeros(len(text) + 1, np.uint32)
        at = base = 0
        for k, part in enumerate(self.specials.split(text) if self.specials else [text]):
            if k % 2:
                words = PATTERN.findall(before)
                near = "".join(words[-2:])
                far = base - sum(self.size[w] for w in words[-2:])
                for cut in range(1, len(part)):
                    out[at + cut] = far + self.count(near + part[:cut])
                base += 1
                at += len(part)
                out[at] = base
                continue
            before, previous = part, None
            for w in PATTERN.findall(part):
                counts = self.prefixes(w.encode("utf-8", "surrogatepass"))
                ends = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in w])
                inner = base + np.array(counts, np.uint32)[ends]
                if w in SPLIT_CONTRACTIONS:  # cut short it isn't a contraction
                    inner[1] = base + self.size[w[0]] + self.size[w[1]]
                if previous is not None and previous.isspace() and w[0].isspace():
                    # cut here, the white space is one run
                    inner[0] = base - self.size[previous] + self.size[previous + w[0]]
                out[at + 1 : at + len(w) + 1] = inner
                base += counts[-1]
                at += len(w)
                previous = w
        return out


class _Sizes(dict):
    """Tokens of a whole word, by prefix counts."""

    def __init__(self, counter: PrefixCounter):
        self.counter = counter

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KEPT:
            # the oldest half stays: common words come early
            old = list(itertools.islice(self.items(), WORDS_KEPT // 2))
            self.clear()
            self.update(old)
        n = self.counter.prefixes(word.encode("utf-8", "surrogatepass"))[-1]
        if len(word) < 100:
            self[word] = n
        return n


@functools.lru_cache(2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, limit: int = 1024, path: str | None = None, prefixes: bool = False) -> DataFrame:
    """Count the tokens of every whole text.

    Returns per input row ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``
    (more than ``limit``) and, if ``prefixes``, ``prefix_tokens``: the count at each
    code-point prefix (little-endian unsigned 32-bit), for :func:`tokens_at` and
    :func:`longest_within`.

    Defined cases: a null text counts as empty (0 bytes, 0 tokens); null or repeated doc_ids
    are carried; an empty table gives no rows; further columns are ignored.
    """
    path = path or default_path()

    def make():
        c = counter(path)

        def use(texts):
            texts = [t or "" for t in texts]
            out = {"n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts]}
            if prefixes:
                found = [c.text_prefixes(t) for t in texts]
                return out | {"n_tokens": [int(x[-1]) for x in found], "prefix_tokens": [x.astype("<u4").tobytes() for x in found]}
            return out | {"n_tokens": [c.count(t) for t in texts]}

        return use

    new = {"n_bytes": "long", "n_tokens": "long"} | ({"prefix_tokens": "binary"} if prefixes else {})
    counted = map_texts(docs, make, new)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def tokens_at(prefix_tokens: bytes, n_chars: int) -> int:
    """Tokens of the first ``n_chars`` code points."""
    return int(np.frombuffer(prefix_tokens, "<u4")[n_chars])


def longest_within(prefix_tokens: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(np.frombuffer(prefix_tokens, "<u4") <= budget)[-1])


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
