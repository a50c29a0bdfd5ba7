"""Toxicity by compression distance.

Two zstandard raw-content dictionaries of equal size: one trained on toxic text, one on ordinary
text.  Both end with the same frequent words, which both kinds of text share; before them the one
holds words, beginnings of words and stretches of two and three words that stand out in toxic text,
the other as many bytes of further ordinary words.  So what the first saves over the second in a window comes from toxic text alone.
A text is cut in short windows; the largest savings, put through a calibrated logistic
threshold, give the score.  The part of its own lies farthest back in a dictionary: a match
there costs more bits than one in frequent words, so that chance matches save nothing.

Whole windows of running text in place of the chosen words were tried and find less: what they
hold besides drowns the difference (held-out figures in the README).
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.llm.common import table
from briefloom.llm.langid import hash_share, held_out
from briefloom.llm.texts import compressor, map_texts

NOT_WORDS = re.compile(r"[\W_]+")
#: Labelled rows of the training sample (half of each label; what one label lacks goes to the other), characters taken of one, from a place its hash gives.
SAMPLE_ROWS, ROW_CHARS = 4000, 20_000
#: Bytes of a window (it ends with a word), level, savings that count.
WINDOW, LEVEL, TOP = 64, 9, 5
#: Frequent words both dictionaries hold, and standard errors by which a toxic unit's share must stand out: of these, what tells
#: a third of the training rows apart best once the other two thirds have given the dictionaries.
ORDINARY_WORDS, STANDS_OUT, RUN_STANDS_OUT = (4000, 8000), (5.0, 8.0, 12.0), 8.0


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def words_of(text: str | None) -> str:
    return NOT_WORDS.sub(" ", text.lower()).strip() if text else ""


def windows_of(words: str) -> list[bytes]:
    """Windows of whole words, at least ``WINDOW`` bytes but for the last."""
    data, out, at = f" {words} ".encode("utf-8", "surrogatepass"), [], 0
    while True:
        end = data.find(b" ", at + WINDOW)
        if end < 0 or end == len(data) - 1:
            out.append(data[at:])
            return out
        out.append(data[at : end + 1])
        at = end


def features(words: str, ordinary, toxic) -> list[float]:
    """The largest savings, the log of the number of windows, and 1."""
    windows = windows_of(words)
    saved = sorted((max(0, len(ordinary.compress(w)) - len(toxic.compress(w))) for w in windows), reverse=True)[:TOP]
    return [*map(float, saved), *[0.0] * (TOP - len(saved)), math.log(len(windows)), 1.0]


def units_of(words: str) -> set[str]:
    """Words and word beginnings of four to six letters."""
    out = set()
    for w in set(words.split()):
        out.add(f"{w} ")
        out.update(w[:n] for n in (4, 5, 6) if len(w) > n)
    return out


def runs_of(words: str) -> set[str]:
    """Stretches of two and three words of the running text."""
    own = words.split()
    return {" ".join([*own[i : i + n], ""]) for n in (2, 3) for i in range(len(own) - n + 1)}


def _frequent_runs(texts: list[str], least: int = 3) -> Counter:
    """Stretches that ``least`` texts hold, and in how many; counted by hash first, so that rare ones take no memory."""
    spot = lambda run: zlib.crc32(run.encode("utf-8", "surrogatepass")) & (1 << 22) - 1
    seen = np.zeros(1 << 22, np.uint16)
    for words in texts:
        seen[list({spot(run) for run in runs_of(words)})] += 1
    return Counter(run for words in texts for run in runs_of(words) if seen[spot(run)] >= least)


def _toxic_units(rows: list[tuple[str, int]]) -> list[tuple[float, str]]:
    """(z, unit) of words, beginnings and stretches that toxic texts have more often, strongest first."""
    n1 = sum(y for _, y in rows)
    n0 = len(rows) - n1
    toxic = _frequent_runs([words for words, y in rows if y])
    for words, y in rows:
        if y:
            toxic.update(units_of(words))
    toxic = {u: a for u, a in toxic.items() if a >= 3}
    clean = Counter(u for words, y in rows if not y for own in (units_of(words), runs_of(words)) for u in own if u in toxic)
    scored = []
    for u, a in toxic.items():
        p = (a + clean[u]) / (n1 + n0)
        if n0 and p < 1:
            scored.append(((a / n1 - clean[u] / n0) / math.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)), u))
    return sorted((x for x in scored if x[0] >= min(STANDS_OUT)), key=lambda x: (-x[0], -len(x[1]), x[1]))


def _chosen(scored: list[tuple[float, str]], least: float) -> list[str]:
    """The units from ``least`` on, without those that stronger ones begin with.

    Stretches count from ``RUN_STANDS_OUT`` on, since there are far more of them to stand out by chance, and
    only where none of their words does: what they add is passages of ordinary words.
    """
    picked: list[str] = []
    begun: set[str] = set()
    alone = [(z, u) for z, u in scored if " " not in u[:-1] and z >= least]
    told = {u for _, u in alone}
    among = lambda u: any(f"{w} " in told or any(w[:n] in told for n in (4, 5, 6)) for w in u.split())
    runs = [(z, u) for z, u in scored if " " in u[:-1] and z >= max(least, RUN_STANDS_OUT) and not among(u)]
    for _, u in sorted(alone + runs, key=lambda x: (-x[0], -len(x[1]), x[1])):
        if u not in begun:
            picked.append(u)
            begun.update(u[:n] for n in range(1, len(u) + 1))
    return picked


def _joined(words, most: int | None = None) -> bytes:
    """The words, the first ones last, each between spaces of its own, in at most ``most`` bytes."""
    out, size = [], 0
    for w in words:
        part = f" {w} ".encode("utf-8", "surrogatepass")
        size += len(part)
        if most is not None and size > most:
            break
        out.append(part)
    return b"".join(reversed(out))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - 0.02 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[str, int]], shift: float = 0.0) -> ToxicityModel:
    """From (text, toxic) rows; repetitions of a whole text with its label count once.

    Two thirds of each label's rows give the dictionaries, the rest the threshold.  Without both
    labels the score is the share of toxic rows.  ``shift`` is added to the log odds, for rows
    whose share of toxic ones isn't the true one.
    """
    own = list(dict.fromkeys((words_of(text), int(y)) for text, y in rows))
    number = Counter(y for _, y in own)
    cut = {y: min(max(1, n * 2 // 3), n - 1) for y, n in number.items()}
    at, first, rest = Counter(), [], []
    for words, y in own:
        (first if at[y] < cut[y] else rest).append((words, y))
        at[y] += 1
    common = Counter()
    for words, y in first:
        if not y:
            common.update(words.split())
    by_count = [w for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))]
    if len({y for _, y in first}) < 2 or len({y for _, y in rest}) < 2:
        shared, share = _joined(by_count[: max(ORDINARY_WORDS)]), (sum(y for _, y in own) + 0.1) / (len(own) + 1)
        return ToxicityModel(shared, shared, (*[0.0] * (TOP + 1), math.log(share / (1 - share))))
    best, scored, seen = None, _toxic_units(first), set()
    y = np.array([y for _, y in rest], float)
    for most in ORDINARY_WORDS:
        for least in STANDS_OUT:
            units = tuple(_chosen(scored, least))
            if (most, units) in seen:
                continue
            seen.add((most, units))
            own_part, shared = f" {' '.join(reversed(units))} ".encode("utf-8", "surrogatepass"), _joined(by_count[:most])
            toxic, ordinary = own_part + shared, _joined(by_count[most:], len(own_part)) + shared
            coders = compressor(ordinary, LEVEL, 2 * WINDOW), compressor(toxic, LEVEL, 2 * WINDOW)
            x = np.array([features(words, *coders) for words, _ in rest])
            w = _logistic(x, y)
            p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-6, 1 - 1e-6)
            loss = -float((y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
            if best is None or loss < best[0]:
                best = loss, ToxicityModel(ordinary, toxic, (*w[:-1], w[-1] + shift))
    return best[1]


def shares(counts: dict[int, int], most: int) -> dict[int, int]:
    """Rows to take of labels 0 and 1: half of ``most`` each, and what one lacks from the other."""
    toxic = min(counts.get(1, 0), max(most // 2, most - counts.get(0, 0)))
    return {0: min(counts.get(0, 0), most - toxic), 1: toxic}


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """From a bounded sample of labelled documents: of each label the ids with the smallest hash, ``SAMPLE_ROWS`` in all."""
    own = labels.where("toxic is not null and doc_id is not null").select("doc_id", (F.col("toxic").cast("int") != 0).cast("int").alias("toxic"))
    counts = {r.toxic: r["count"] for r in own.groupBy("toxic").count().collect()}
    ids, taken = None, shares(counts, SAMPLE_ROWS)
    for y, most in taken.items():
        # enough, however many rows there are
        near = own.where((F.col("toxic") == y) & (hash_share("doc_id") * counts.get(y, 0) <= 2.0 * most))
        part = near.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        ids = part if ids is None else ids.unionByName(part)
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - ROW_CHARS, F.lit(0)) + 1) + 1
    rows = (
        docs.select("doc_id", F.substring(F.col("text"), start.cast("int"), F.lit(ROW_CHARS)).alias("text"))
        .join(F.broadcast(ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text")
        .collect()
    )
    # the sample's log odds against those of all labelled rows
    shift = math.log(counts[1] * taken[0] / (counts[0] * taken[1])) if len(counts) == 2 else 0.0
    return fit([(r.text, r.toxic) for r in rows], shift)


def score(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Score every whole text: ``keep``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5).

    Defined cases: a null or empty text is one empty window; null and repeated doc_ids are
    carried; an empty table gives no rows; further columns are ignored.
    """

    def make():
        coders = compressor(model.ordinary, LEVEL, 2 * WINDOW), compressor(model.toxic, LEVEL, 2 * WINDOW)
        weights = np.array(model.weights)

        def use(texts):
            x = np.array([features(words_of(t), *coders) for t in texts]).reshape(len(texts), TOP + 2)
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            return {"score": p, "predicted": (p >= 0.5).astype(np.int32)}

        return use

    return map_texts(docs, make, {"score": "double", "predicted": "int"}, keep)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = held_out(folds=5, fold=0)
    model = train(docs, table(spark, sf_dir, "labels").where(~fold))
    return score(docs, model).select("doc_id", fold.alias("held_out"), "score", "predicted")
