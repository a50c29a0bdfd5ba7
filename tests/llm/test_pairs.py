"""Operators on pairs and groups against brute force."""

import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from briefloom.llm import blocks, embeddings, ngram_join
from briefloom.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOCS)


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def edited(words, r, n, vocabulary):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = r.choice(vocabulary)
    return out


def brute(texts, threshold=0.8, n=5):
    sets = {i: set(ngram_join.grams(ngram_join.words_of(t), n).tolist()) for i, t in texts.items()}
    edges = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    return edges, components(sets, edges)


def test_band_plan_reaches_recall():
    for t, recall in ((0.8, 0.9999), (0.5, 0.95)):
        bands, rows = ngram_join.band_plan(t, recall)
        assert 1 - (1 - t**rows) ** bands >= recall > 1 - (1 - t**rows) ** (bands - 1)


@pytest.mark.parametrize("block", [400_000, 3_000])
def test_join_equals_brute_force(spark, monkeypatch, block):
    """Also with groups cut in many blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", block)
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = {}
    for base in range(12):
        words = [r.choice(vocabulary) for _ in range(r.choice((3, 20, 60, 150)))]
        for _ in range(r.choice((1, 2, 9))):
            texts[len(texts)] = " ".join(edited(words, r, r.choice((0, 0, 1, 2, 4)), vocabulary))
    chain = [r.choice(vocabulary) for _ in range(60)]
    for _ in range(12):  # neighbours are similar, ends are not
        chain = edited(chain, r, 1, vocabulary)
        texts[len(texts)] = " ".join(chain)
    edges, root = brute(texts)
    got = {x.doc_id: x for x in ngram_join.ngram_jaccard_join(docs_of(spark, list(texts.values()))).collect()}
    for i in texts:
        assert got[i].class_id == root[i] and got[i].n_links == sum(i in e for e in edges) and got[i].kept == (root[i] == i)


def test_join_on_hard_rows(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, "a b c"), (2, "A, b; c"), (3, None), (4, ""), (5, "... !!"), (6, long), (7, long + " x"), (None, "a b c"), (8, "a b c d"), (9, "z"), (9, "z"), (10, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "component": F.lit("x"), "rep": F.lit(2), "kept": F.lit(False)})
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.kept) for r in ngram_join.ngram_jaccard_join(df).collect()), key=lambda r: (r[0] is None, r))
    assert got == [
        (1, 1, 1, True), (2, 1, 1, False), (3, 3, 0, True), (4, 4, 0, True), (5, 5, 0, True), (6, 6, 1, True), (7, 6, 1, False), (8, 8, 0, True),
        (9, 9, 1, True), (9, 9, 1, True), (10, 10, 0, True), (None, None, 0, True),
    ]
    assert ngram_join.ngram_jaccard_join(df.limit(0)).count() == 0
    left = ngram_join.deduplicated(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id for r in left.collect()), key=lambda i: (i is None, i)) == [1, 3, 4, 5, 6, 8, 9, 10, None]


def test_texts_that_share_a_doc_id_are_told_apart(spark):
    """No text goes that nothing else holds, and one of each group stays."""
    words = lambda k, n=60: [f"{k}w{i}" for i in range(n)]
    a, b, c, d = (" ".join(words(k)) for k in "abcd")
    near_b = " ".join([*words("b")[:-1], "other"])
    cases = [
        ([(3, a), (5, a), (5, b)], [(3, a), (5, b)]),
        ([(2, near_b), (5, a), (5, b)], [(2, near_b), (5, a)]),
        ([(5, b), (5, near_b), (7, b)], None),
        ([(5, a), (5, b), (7, a), (7, c), (7, c), (None, a), (8, None), (8, None), (8, d)], [(5, a), (5, b), (7, c), (None, a), (8, None), (8, d)]),
    ]
    for rows, want in cases:
        df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
        got = [(r.doc_id, r.text) for r in ngram_join.deduplicated(df).collect()]
        if want is None:
            assert len(got) == 1 and got[0][0] == 5
        else:
            assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_spanning_joins_rows_and_columns():
    hit = np.array([[0, 1, 0], [0, 1, 1], [0, 0, 0], [0, 0, 1]], bool)
    rows, columns = blocks.spanning(hit, same=False)
    assert rows.tolist() == [0, 0, -1, 0] and columns.tolist() == [-1, 0, 0]


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(1000, k) for k in range(1001, 1100)] + [(5, 5)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 1 for k in range(1, 61)} | {k: 1000 for k in range(1000, 1100)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_embeddings_equal_sql(spark, small, tmp_path):
    con = duckdb.connect()
    r = np.random.RandomState(0)
    base = spark.read.parquet(f"{small}/embeddings.parquet").limit(120).collect()
    rows = [(x.vec_id, x.embedding, x.label) for x in base]
    for k in range(60):
        v = np.array(base[k % 20].embedding)
        rows.append((1000 + k, (v * 3 + r.normal(size=len(v)) * 0.03 * (k % 4)).tolist(), base[k % 20].label))
    bad = [None, [0.0] * 64, [float("nan")] + [1.0] * 63, [None] + [1.0] * 63, [float("inf")] * 64]
    rows += [(2000 + k, v, 1) for k, v in enumerate(bad)] + [(2100, base[0].embedding, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"file://{tmp_path}/e")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    want = sorted(con.execute(embeddings.ORACLE).fetchall())
    got = sorted(tuple(x) for x in embeddings.near_duplicates(df).collect())
    assert got == want and sum(w[1] > 0 for w in want) > 50


def test_cells_lose_no_link(spark, monkeypatch):
    for name, value in (("CELL", 20), ("BLOCK", 16)):
        monkeypatch.setattr(embeddings, name, value)
    r = np.random.RandomState(1)
    x = r.normal(size=(150, 8))
    x = np.concatenate([x, x[:80] + r.normal(size=(80, 8)) * 0.3])
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T >= 0.93
    np.fill_diagonal(s, False)
    root = components(range(len(x)), np.argwhere(np.triu(s)).tolist())
    got = {r_.vec_id: r_ for r_ in embeddings.near_duplicates(df).collect()}
    assert all(got[k].n_links == s[k].sum() and got[k].component_id == root[k] for k in got) and s.sum() > 50


@pytest.mark.parametrize("visits, chunk", [(0, 2_000), (2, 10**9), (5, 700)])
def test_wide_vectors_equal_brute_force(spark, monkeypatch, visits, chunk):
    """All vectors, or those of many cells, by chunks of a few, beside others that are copied; copies, labels, two lengths."""
    for name, value in {"CELL": 8, "PER_CELL": 4, "BLOCK": 16, "VISITS": visits, "CHUNK_BYTES": chunk, "STRIPE": 7}.items():
        monkeypatch.setattr(embeddings, name, value)
    r = np.random.RandomState(visits)
    rows = []
    for label, dims in ((0, 6), (1, 6), (1, 5)):
        x = r.normal(size=(90, dims))
        x = np.concatenate([x, x[:50] + r.normal(size=(50, dims)) * 0.25, x[:4]])
        rows += [(len(rows) + k, v.tolist(), label) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    link = lambda a, b: a[2] == b[2] and len(a[1]) == len(b[1]) and np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93
    edges = [(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if link(a, b)]
    root, links = components([k for k, *_ in rows], edges), {k: 0 for k, *_ in rows}
    for a, b in edges:
        links[a] += 1
        links[b] += 1
    got = embeddings.near_duplicates(df).collect()
    assert {(x.vec_id, x.n_links, x.component_id) for x in got} == {(k, links[k], root[k]) for k in links} and len(edges) > 60


def test_visited_cells_hold_every_partner():
    """The rule itself: a partner at home in a lower cell is always visited, on both levels."""
    r = np.random.RandomState(5)
    x = embeddings.unit(r.normal(size=(60, 6)))
    x = embeddings.unit(np.repeat(x, 5, axis=0) + r.normal(size=(300, 6)) * 0.2)
    top, below = embeddings.fit_cells(x[::2], 20)
    assert sum(map(len, below)) > 10
    visited = embeddings.cells_visited(x, top, below, math.sqrt(2 - 2 * 0.93))
    home = [v[0] for v in visited]
    close = np.argwhere(np.triu(x @ x.T >= 0.93, 1))
    assert len(close) > 100 and len({*home}) > 8
    for a, b in close:
        assert min(home[a], home[b]) in visited[a if home[a] > home[b] else b]
    assert all(len(set(v)) == len(v) and max(v) == v[0] for v in visited) and np.mean([len(v) for v in visited]) < len({*home})


def test_embeddings_on_hard_rows(spark):
    v = [1.0, 2.0]
    rows = [(1, v, 0), (1, v, 0), (None, v, 0), (2, [2.0, 4.0], 0), (3, [1e300, 2e300], 0), (4, [1.0, 2.0, 0.0], 0), (5, [], 0), (6, v, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("group", F.lit("x")).withColumn("vector", F.lit(1))
    got = sorted(tuple(-1 if c is None else c for c in r) for r in embeddings.near_duplicates(df).collect())
    assert got == [(-1, 0, -1, True), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True)]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1, 100, 3000])
def test_a_similarity_of_just_the_threshold_links(scale):
    a, b = np.arange(9 * scale, dtype=np.uint64), np.arange(scale, 10 * scale, dtype=np.uint64)
    assert ngram_join.links_within([a], [b], 0.8).all() and not ngram_join.links_within([a], [np.append(b, np.uint64(20 * scale))], 0.8).any()
