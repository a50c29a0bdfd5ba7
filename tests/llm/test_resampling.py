"""Importance resampling against a plain model."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from briefloom.llm import resampling


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def buckets_of(words):
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def model(docs, target):
    """(doc_id, n_features, weight, score, rank) of each row."""
    s, t = (Counter(b for x in texts for b in buckets_of(words_of(x))) for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    out, able = [], []
    for k, x in docs:
        words = words_of(x)
        found = buckets_of(words)
        weight, score = sum(gain[b] for b in found), None
        if k is not None:
            h = int(hashlib.sha256(f"42:{k}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
            if len(words) >= 20:
                able.append((-score, k, len(out)))
        out.append([k, len(found), weight, score, None])
    for rank, (*_, at) in enumerate(sorted(able)[: 5 * len(able) // 100], 1):
        out[at][4] = rank
    return sorted(map(tuple, out), key=repr)


def test_query_equals_model(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = resampling.op13_importance_resampling(spark, small)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == model(docs, target)


@pytest.mark.parametrize("small_runs", [False, True])
def test_hard_rows_equal_model(spark, monkeypatch, small_runs):
    """Nulls, empty and long texts, words of any length, repeated rows; also with many short runs and ranges."""
    if small_runs:
        monkeypatch.setattr(resampling, "RANGE", 9)
        monkeypatch.setattr(resampling, "PIECE", 7)
    r = random.Random(2)
    word = lambda: r.choice(["Rates", "rise", "é" * 40, "x" * 70, "漢字" * 300, "a", "1", "ÀÉ", "z" * 5000])
    docs = [(k, " ".join(word() for _ in range(r.randrange(60)))) for k in range(400)]
    docs += [(500, None), (501, ""), (None, "rates rise " * 30), (7, docs[7][1]), (7, docs[7][1]), (502, "\x00 <>& \t" * 50), (503, "rise " * 70000)]
    target = ["Rates rise, a 1", None, "x" * 70]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"run": F.lit("x"), "rank": F.lit(1), "score": F.lit(None).cast("long")})
    got = resampling.resampled(df.repartition(5), spark.createDataFrame([(t,) for t in target], "text string")).collect()
    assert sorted(map(tuple, got), key=repr) == model(docs, target)


def test_empty_tables(spark):
    docs, target = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert resampling.resampled(docs, target).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert resampling.resampled(one, target).first().rank is None


def test_tournament_merges_runs():
    r = random.Random(1)
    for k in (1, 2, 3, 7, 64, 65):
        runs = [sorted((r.randrange(20), i, j) for j in range(r.randrange(9))) for i in range(k)]
        flat = sorted(x for run in runs for x in run)
        assert list(resampling.merged([list(x) for x in runs])) == flat
        assert list(resampling.merged([list(x) for x in runs], fan_in=2)) == flat
    assert list(resampling.merged([])) == []


def test_checksums_join():
    sums, r = resampling.Checksums(), random.Random(0)
    pairs = [(r.randbytes(r.randrange(300)), r.randbytes(r.choice([0, 1, 5, 63, 64, 65, 200, 70000]))) for _ in range(60)]
    column = lambda f: np.array([f(p) for p in pairs], np.int64)
    got = sums.joined(column(lambda p: zlib.crc32(p[0])), column(lambda p: zlib.crc32(p[1])), column(lambda p: len(p[1])))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]
