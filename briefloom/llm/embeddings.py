"""Near-duplicate embeddings by spherical k-means cells and blocked cosine products.

Equal vectors form one class and are compared once.  Each label has cells of its own, two at
least and one for every ``CELL`` vectors: spherical k-means in two levels, fitted in the label's
own task on a bounded sample.  A class is at home in the cell of the nearest centroid, and also
visits every cell that could hold a vector within the similarity threshold: if x is nearest to
h and y to c, then y lies on c's side of the plane between them, so
x.(h - c) <= |x - y| |h - c|, and |x - y| is bounded by the threshold; this holds on both
levels.  A pair is compared once, in the lower of its two home cells, so no link is lost.
Cells are compared in blocks; a task returns counts and spanning edges, not pairs.

Where vectors have no cluster structure the bound excludes little.  A vector that would visit more
than ``VISITS`` cells isn't copied to them: such wide vectors are broadcast, a bounded chunk at a time, and
every chunk meets the vectors of lower home cells where they are read.  So what is written and
shuffled stays in proportion to the vectors, whatever their structure.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.llm.blocks import block_cells, compared, spanning
from briefloom.llm.common import connected_components, table, written
from briefloom.llm.langid import hash_share

#: Vectors a cell should hold, sample vectors a cell, sample vectors of a label at most (beyond CELL * SAMPLE / PER_CELL vectors cells grow).
CELL, PER_CELL, SAMPLE = 2048, 16, 65_536
#: Vectors of one side of a comparison, and of one task that assigns cells.
BLOCK, ASSIGNED = 2048, 4096
#: Cells that a vector is copied to at most, bytes of a chunk of wide vectors on average, and of these vectors compared at once.
VISITS, CHUNK_BYTES, STRIPE = 16, 32_000_000, 4096


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 0) -> np.ndarray:
    """k unit centroids of unit rows ``x`` (fewer if x has fewer rows)."""
    r = np.random.RandomState(seed)
    c = x[r.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        home = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1)
        c[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return c


def unit(vectors: np.ndarray) -> np.ndarray:
    # scaled first: squares of very large or small numbers would overflow
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def stacked(vectors: list) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vectors])


def cosine_hits(threshold: float):
    def hits(a: list, b: list | None) -> np.ndarray:
        x = unit(stacked(a))
        hit = (x @ (x if b is None else unit(stacked(b))).T) >= threshold
        if b is None:
            np.fill_diagonal(hit, False)
        return hit

    return hits


def fit_cells(x: np.ndarray, cells: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Two levels of spherical k-means over unit rows ``x``: centroids, and each one's own centroids."""
    top = spherical_kmeans(x, math.ceil(math.sqrt(cells)))
    home = (x @ top.T).argmax(axis=1)
    each = math.ceil(cells / len(top))
    own = [x[home == k] for k in range(len(top))]
    return top, [spherical_kmeans(part, each) if len(part) else top[k : k + 1] for k, part in enumerate(own)]


def cells_visited(x: np.ndarray, top: np.ndarray, below: list[np.ndarray], far: float) -> list[list[int]]:
    """Each unit row's cells: its home, then the lower ones that may hold a vector no farther than ``far``."""
    width = max(map(len, below))

    def level(rows: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = rows @ c.T
        home = s.argmax(axis=1)
        apart = np.sqrt(np.maximum(0, ((c[:, None] - c[None]) ** 2).sum(axis=2))) if len(c) < 64 else np.sqrt(np.maximum(0, 2 - 2 * c @ c.T))
        return home, s[np.arange(len(rows)), home][:, None] - s <= (far * apart + 1e-9)[home]

    home, near = level(x, top)
    visited: list[list[int]] = [[] for _ in x]
    first = np.zeros(len(x), np.int64)
    for a, c in enumerate(below):
        rows = np.flatnonzero((home >= a) & near[:, a])
        if not len(rows):
            continue
        own, close = level(x[rows], c)
        at_home = home[rows] == a
        first[rows[at_home]] = a * width + own[at_home]
        close &= ~at_home[:, None] | (np.arange(len(c))[None] < own[:, None])
        for r, j in zip(*np.nonzero(close)):
            visited[rows[r]].append(int(a * width + j))
    return [[int(h), *v] for h, v in zip(first, visited)]


def _placed(classes: DataFrame, far: float) -> DataFrame:
    """``classes`` with their ``cells``: fitted a label a task, assigned in tasks of a bounded number of vectors."""
    counts = classes.groupBy("group").agg(F.count("*").alias("__rows"))
    cells = F.least(F.greatest(F.lit(2), F.ceil(F.col("__rows") / CELL)), F.lit(SAMPLE // PER_CELL)).cast("int")
    # a hash picks about the rows wanted, whatever a label holds
    picked = (
        classes.select("group", "rep", "vector").join(counts, "group")
        .where(hash_share("rep") * F.col("__rows") <= PER_CELL * cells).select("group", "rep", "vector", cells.alias("cells"))
    )

    def fit(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("rep")
        x = unit(np.array(t["vector"].combine_chunks().flatten()).reshape(t.num_rows, -1))
        top, below = fit_cells(x, t["cells"][0].as_py())
        held = io.BytesIO()
        np.savez(held, top, *below)
        return pa.table({"group": [key[0].as_py()], "model": pa.array([held.getvalue()], pa.binary())})

    models = written(picked.groupBy("group").applyInArrow(fit, "group string, model binary"), "cells")
    parts = F.ceil(F.col("__rows") / ASSIGNED).cast("int")
    models = counts.join(models, "group", "left").select(F.col("group").alias("of"), "model", F.explode(F.sequence(F.lit(0), parts - 1)).alias("of_part"))
    dealt = classes.select("rep", "mult", "group", "vector").join(counts, "group").withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int")).drop("__rows")

    def assign(vectors: pa.Table, model: pa.Table) -> pa.Table:
        held = model["model"][0].as_py() if model.num_rows else None
        if held is None or not vectors.num_rows:  # no row of a very small label was picked: one cell
            cells = [[0]] * vectors.num_rows
        else:
            arrays = np.load(io.BytesIO(held))
            top, *below = [arrays[name] for name in arrays.files]
            x = unit(np.array(vectors["vector"].combine_chunks().flatten()).reshape(vectors.num_rows, -1))
            cells = cells_visited(x, top, below, far)
        wide = [len(c) > VISITS + 1 for c in cells]
        own = vectors.select(["rep", "mult", "group", "vector"]).append_column("wide", pa.array(wide, pa.bool_()))
        return own.append_column("cells", pa.array([c[:1] if w else c for c, w in zip(cells, wide)], pa.list_(pa.int32())))

    return dealt.groupBy("group", "part").cogroup(models.groupBy("of", "of_part")).applyInArrow(
        assign, "rep long, mult long, group string, vector array<double>, wide boolean, cells array<int>"
    )


def _compared_with(shared, threshold: float):
    """Maps batches of (rep, mult, group, cell, vector) to (rep, links, root) rows of their links with the vectors of ``shared`` in higher home cells."""

    def rows(ids: np.ndarray, root: np.ndarray, count: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
        got = root >= 0
        return pa.RecordBatch.from_arrays([pa.array(ids[got]), pa.array(count[got].astype(np.int64)), pa.array(of[root[got]])], ["rep", "links", "root"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            groups = batch.column("group").to_numpy(zero_copy_only=False)
            for g in set(groups) & set(held):
                own = batch.take(pa.array(np.flatnonzero(groups == g)))
                rep, mult, cell = (own.column(c).to_numpy() for c in ("rep", "mult", "cell"))
                y = unit(np.array(own.column("vector").flatten()).reshape(own.num_rows, -1))
                reps, mults, cells, x = held[g]
                for at in range(0, len(reps), STRIPE):
                    part = slice(at, at + STRIPE)
                    hit = (y @ x[part].T >= threshold) & (cell[:, None] < cells[part][None])
                    if hit.any():
                        r, c = spanning(hit, False)
                        yield rows(rep, r, hit @ mults[part], rep)
                        yield rows(reps[part], c, mult @ hit, rep)

    return compare


def _wide_links(visits: DataFrame, threshold: float) -> DataFrame | None:
    """(rep, links, root) of wide vectors with all of lower home cells; a pass over the vectors for each chunk."""
    homes = visits.where("not visits").select("rep", "mult", "group", "cell", "vector", "wide")
    wide = homes.where("wide")
    size = wide.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims")).first()
    if not size.n:
        return None
    chunks = math.ceil(8 * size.n * size.dims / CHUNK_BYTES)
    spark, found = visits.sparkSession, None
    for k in range(chunks):
        t = wide.where(F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(chunks)) == k).toArrow()
        groups, chunk = t["group"].to_numpy(), {}
        for g in set(groups):
            own = t.take(np.flatnonzero(groups == g))
            x = unit(own["vector"].combine_chunks().flatten().to_numpy().reshape(own.num_rows, -1))
            chunk[g] = (*(own[c].to_numpy() for c in ("rep", "mult", "cell")), x)
        shared = spark.sparkContext.broadcast(chunk)
        part = homes.drop("wide").mapInArrow(_compared_with(shared, threshold), "rep long, links long, root long")
        part = written(part.groupBy("rep", "root").agg(F.sum("links").alias("links")).select("rep", "links", "root"), "wide")
        found = part if found is None else found.unionByName(part)
        shared.unpersist()
    return found


def near_duplicates(
    rows: DataFrame, threshold: float = 0.93, id_column: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """Link vectors of equal label whose cosine is at least ``threshold``.

    Returns per input row the id, ``n_links`` (other rows linked directly), ``component_id``
    (smallest id reachable by links, itself included) and ``kept`` (id = component_id).

    Defined cases: vectors that are null, empty, zero or hold null or non-finite components,
    and rows with a null label, link with nothing; so do rows with a null id, which are kept
    with a null component; vectors of different lengths don't link; repeated rows are
    copies of each other; an empty table gives no rows; further columns are ignored.
    """
    v = F.col(vector).cast("array<double>")
    fine = (
        F.col(id_column).isNotNull() & F.col(label).isNotNull() & v.isNotNull()
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    group = F.concat_ws(":", F.col(label).cast("string"), F.size(v))
    base = rows.select(
        F.col(id_column).cast("long").alias("id"),
        F.when(fine, group).alias("group"),
        F.when(fine, v).alias("vector"),
        F.when(fine, F.xxhash64(group, v)).alias("k1"),
        F.when(fine, F.xxhash64(v, F.lit(17), group)).alias("k2"),
    )
    classes = written(
        base.where("k1 is not null").groupBy("k1", "k2").agg(
            F.min("id").alias("rep"), F.count("*").alias("mult"), F.first("group").alias("group"), F.first("vector").alias("vector")
        ),
        "vectors",
    )
    placed = _placed(classes, math.sqrt(2 - 2 * threshold) + 1e-9)
    visits = written(
        placed.select("rep", "mult", "group", "vector", "wide", F.posexplode("cells").alias("visits", "cell")).withColumn("visits", F.col("visits") > 0), "visits"
    )
    n = visits.groupBy("group", "cell").agg(
        F.count(F.when(~F.col("visits"), 1)).alias("homes"), F.count(F.when(F.col("visits"), 1)).alias("guests")
    )
    blocks = n.select(
        "group", "cell", "homes", "guests",
        F.greatest(F.lit(1), F.ceil(F.col("homes") / BLOCK)).cast("int").alias("home_blocks"),
        F.ceil(F.col("guests") / BLOCK).cast("int").alias("guest_blocks"),
    )
    total = n.agg(F.sum("homes")).first()[0] or 0
    bins = max(1, math.ceil(total / BLOCK))
    dealt = visits.join(blocks, ["group", "cell"]).withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.when(F.col("visits"), F.col("guest_blocks")).otherwise(F.col("home_blocks"))).cast("int")
    )
    cell = F.concat_ws("/", "group", "cell")
    own = F.transform(
        block_cells(F.col("block"), F.col("home_blocks")),
        lambda c: F.struct(F.concat_ws("/", cell, F.lit("h"), c["i"], c["j"]).alias("sub"), c["side"].alias("side")),
    )
    with_guests = F.when(
        F.col("guest_blocks") > 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(F.col("guest_blocks"), F.lit(1)) - 1),
            lambda k: F.struct(F.concat_ws("/", cell, F.lit("g"), "block", k).alias("sub"), F.lit(0).alias("side")),
        ),
    ).otherwise(F.array().cast("array<struct<sub:string,side:int>>"))
    as_guest = F.transform(
        F.sequence(F.lit(0), F.col("home_blocks") - 1),
        lambda k: F.struct(F.concat_ws("/", cell, F.lit("g"), k, "block").alias("sub"), F.lit(1).alias("side")),
    )
    members = (
        dealt.select("rep", "mult", "vector", "homes", "guests", F.explode(F.when(F.col("visits"), as_guest).otherwise(F.concat(own, with_guests))).alias("m"))
        .select("rep", "mult", "vector", "homes", "guests", "m.sub", "m.side")
        # small groups share tasks
        .withColumn(
            "task",
            F.when((F.col("homes") <= BLOCK // 8) & (F.col("guests") <= BLOCK // 8), F.concat(F.lit("s"), F.pmod(F.xxhash64("sub"), F.lit(bins)))).otherwise(F.col("sub")),
        )
        .select("task", "sub", "side", "rep", "mult", "vector")
    )
    found = written(compared(members, "vector", cosine_hits(threshold)), "cosines")
    more = _wide_links(visits, threshold)
    found = found if more is None else found.unionByName(more)
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    linked = (
        classes.select("k1", "k2", "rep", "mult")
        .join(counts, "rep", "left")
        .join(parts.withColumnRenamed("id", "rep"), "rep", "left")
        .select("k1", "k2", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    return base.select("id", "k1", "k2").join(linked, ["k1", "k2"], "left").select(
        F.col("id").alias(id_column),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
    )


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT e.vec_id, COALESCE(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e
LEFT JOIN (SELECT a, CAST(COUNT(*) AS BIGINT) AS n_links FROM links GROUP BY a) n ON n.a = e.vec_id
JOIN (SELECT a, MIN(b) AS component_id FROM reach GROUP BY a) c ON c.a = e.vec_id
"""
