"""Conversation prefix trie by partition refinement.

All conversations start in one class.  Each round takes the next turns of the conversations
that still share theirs with another text, splits the classes turn by turn and retires every
class of one: its remaining turns are a chain of nodes of its own, written out as they are.
Equal conversations count as one throughout, so that copies never keep a class alive.  Rounds
take 1, 2, 4 and so on up to 1,024 turns: their number grows with the logarithm of the
longest shared beginning up to there.

A class goes by a 128-bit digest of its turns and their places.  Sums over subtrees are folded
back without a walk from level to level: a node belongs to its smallest member, so what a
conversation owns is one run of nodes at the end of its path, and a prefix holds the whole runs
of its members and the rest of its owner's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from briefloom.llm.common import dropped, table, written
from briefloom.llm.conversations import BLOCK, by_blocks, numbered, sums_from, turn_rows
from briefloom.llm.texts import small_batches

#: Ids joined in one string before they are hashed.
IDS = 4096
KEY = ["n", "a", "b"]
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NOTHING = hashlib.sha256(b"").hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the strings of each key, which come one after the other in order."""
    now, held = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in now] + [pa.array([held.hexdigest()])], [*KEY, "long_ends"])

    for batch in batches:
        for *key, ids in zip(*[batch.column(k).to_pylist() for k in range(4)]):
            if key != now:
                if held is not None:
                    yield out()
                now, held = key, hashlib.sha256(ids.encode())
            else:
                held.update(b"," + ids.encode())
    if held is not None:
        yield out()


def copies_of(whole: DataFrame) -> DataFrame:
    """(conv_id, n, a, b, copies, ends) of ``whole(conv_id, n, a, b)``: a row for each distinct conversation.

    ``ends`` is the SHA-256 of its copies' ids, ascending, joined by commas.  Ids are joined
    within ranges; only a group of copies that more than one range holds is hashed string
    after string, by one task that keeps nothing but the state of the hash.
    """
    ranges = written(whole.repartitionByRange(*KEY, "conv_id").withColumn("part", F.spark_partition_id()), "copies")
    own = ranges.groupBy(*KEY, "part").agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    text = lambda ids: F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")
    runs = own.withColumn("run", F.explode(F.transform(F.sequence(F.lit(1), F.size("ids"), F.lit(IDS)), lambda k: F.struct(k.alias("k"), F.slice("ids", k, IDS).alias("ids")))))
    runs = written(runs.select(*KEY, "part", "run.k", F.col("run.ids")[0].alias("first"), F.size("run.ids").alias("size"), text(F.col("run.ids")).alias("ids")), "runs")
    classes = runs.groupBy(*KEY).agg(
        F.min("first").alias("conv_id"), F.sum("size").alias("copies"), F.count("*").alias("runs"), F.sha2(F.min("ids"), 256).alias("ends")
    )
    long_runs = runs.join(classes.where("runs > 1").select(*KEY), KEY, "left_semi")
    small_batches(whole)
    streamed = long_runs.repartition(*KEY).sortWithinPartitions(*KEY, "part", "k").select(*KEY, "ids")
    hashed = streamed.mapInArrow(_digests, "n long, a long, b long, long_ends string")
    out = classes.join(hashed, KEY, "left").withColumn("ends", F.coalesce("long_ends", "ends"))
    return out.select("conv_id", *KEY, "copies", "ends")


def trie_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of ``turns(conv_id, place, digest, chars)`` and ``convs(conv_id, n)``, the latter with every conversation, turnless ones too."""
    mark = turns.select(
        "conv_id", "place", "chars", F.xxhash64("place", "digest").alias("x"), F.xxhash64("digest", F.lit(7), "place").alias("y")
    )
    sums = mark.groupBy("conv_id").agg(F.bit_xor("x").alias("a"), F.bit_xor("y").alias("b"))
    nil = F.lit(0).cast("long")
    whole = convs.join(sums, "conv_id", "left").select("conv_id", F.col("n").cast("long").alias("n"), F.coalesce("a", nil).alias("a"), F.coalesce("b", nil).alias("b"))
    reps = written(copies_of(whole), "distinct")
    own = written(by_blocks(mark, reps.select("conv_id", "n", "copies", "ends")), "turns")

    active = written(reps.where("n > 0").select("conv_id", "n", nil.alias("a"), nil.alias("b")), "active")
    start, width, rows, nodes, retired = 0, 1, [], [], []
    while not active.isEmpty():
        end = start + width
        now = own.where((F.col("place") >= start) & (F.col("place") < end)).drop("n", "ends").join(active, "conv_id")
        # a conversation has at most BLOCK rows here
        run = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        for total, part in (("a", "x"), ("b", "y")):
            now = now.withColumn(total, F.col(total).bitwiseXOR(F.bit_xor(part).over(run)))
        now = written(now.select("conv_id", "place", "n", "copies", "chars", "a", "b", F.expr("a ^ x").alias("up_a"), F.expr("b ^ y").alias("up_b")), "split")
        split = now.groupBy("place", "a", "b").agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("members"), F.sum("copies").alias("n_convs"), F.max("n").alias("n"),
            F.min("chars").alias("chars"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"),
        )
        split = written(split, "nodes")
        alone = split.where((F.col("place") == end - 1) & (F.col("members") == 1)).select("conv_id")
        going = now.where((F.col("place") == end - 1) & (F.col("n") > end))
        retired.append(going.join(alone, "conv_id", "left_semi").select("conv_id", "n", F.lit(end).cast("long").alias("cut")))
        before, active = active, written(going.join(alone, "conv_id", "left_anti").select("conv_id", "n", "a", "b"), "active")
        dropped(before)
        rows.append(now)
        nodes.append(split)
        start, width = end, min(2 * width, BLOCK)
    if not nodes:  # no conversation has a turn
        return _root(reps, None, None)

    union = lambda parts: reduce(DataFrame.unionByName, parts)
    cut = union(retired)
    tails = by_blocks(own.drop("n"), cut, F.col("cut")).where("place >= cut").withColumn("s", (F.col("copies") - 1) * F.col("chars"))
    shared = union(nodes).withColumn("s", (F.col("n_convs") - 1) * F.col("chars"))

    # what each conversation owns: its nodes' savings, and whether its last node is a leaf
    leaf = (F.col("members") == 1) & (F.col("place") == F.col("n") - 1)
    owned = shared.select("conv_id", "s", leaf.cast("long").alias("leaf")).unionByName(
        tails.where("copies > 1").select("conv_id", "s", nil.alias("leaf"))
    ).unionByName(cut.select("conv_id", nil.alias("s"), F.lit(1).cast("long").alias("leaf")))
    runs = written(owned.groupBy("conv_id").agg(F.sum("s").alias("run"), F.max("leaf").alias("leaf")), "owned")
    members = union(rows).select("conv_id", "place", "a", "b").join(runs, "conv_id")
    folded = members.groupBy("place", "a", "b").agg((F.sum("run") - F.min_by("run", "conv_id")).alias("others"), F.sum("leaf").alias("n_leaves"))

    by_owner = shared.select("conv_id", "place", "s", "a", "b", "members", "n_convs", "n", "up_a", "up_b", nil.alias("in_tail")).unionByName(
        tails.where("copies > 1").select(
            "conv_id", "place", "s", nil.alias("a"), nil.alias("b"), F.lit(1).cast("long").alias("members"), F.col("copies").alias("n_convs"), "n",
            nil.alias("up_a"), nil.alias("up_b"), F.lit(1).cast("long").alias("in_tail"),
        )
    )
    by_owner = written(sums_from(by_owner, "s", "own"), "sums")
    top = reps.agg(F.min("conv_id")).first()[0]

    kids = shared.where("place > 0").groupBy((F.col("place") - 1).alias("place"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("kids"))
    up = shared.select((F.col("place") + 1).alias("place"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("up"))
    at_end = reps.where("n > 0").select((F.col("n") - 1).alias("place"), "a", "b", "ends")
    inner = (
        by_owner.where("in_tail = 0").join(folded, ["place", "a", "b"]).join(kids, ["place", "a", "b"], "left").join(at_end, ["place", "a", "b"], "left")
        .join(up, ["place", "up_a", "up_b"], "left")
    )
    goes_on = (F.col("place") < F.col("n") - 1).cast("long")
    depth = (F.col("place") + 1).alias("depth")
    inner = inner.select(
        "conv_id", depth, F.when(F.col("place") == 0, F.lit(top).cast("long")).otherwise(F.col("up")).alias("parent_conv_id"), "n_convs",
        F.when(F.col("members") == 1, goes_on).otherwise(F.coalesce("kids", nil)).alias("n_children"), "n_leaves",
        (F.col("own") + F.col("others")).alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"),
    )
    chain = tails.where("copies = 1").select("conv_id", "place", "n", "copies", nil.alias("own"), "ends").unionByName(
        by_owner.where("in_tail = 1").join(reps.select("conv_id", "copies", "ends"), "conv_id").select("conv_id", "place", "n", "copies", "own", "ends")
    ).select(
        "conv_id", depth, F.col("conv_id").alias("parent_conv_id"), F.col("copies").alias("n_convs"), goes_on.alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.col("own").alias("saved_tokens"), F.when(goes_on == 0, F.col("ends")).otherwise(F.lit(NOTHING)).alias("ends_sha256"),
    )
    return inner.unionByName(chain).unionByName(_root(reps, runs, shared)).select(*COLUMNS)


def _root(reps: DataFrame, runs: DataFrame | None, nodes: DataFrame | None) -> DataFrame:
    """The textless node; none if there are no conversations."""
    nil = F.lit(0).cast("long")
    blank = {"conv_id": F.lit(None).cast("long"), "copies": nil, "ends": F.lit(None).cast("string"), "kids": nil, "leaf": nil, "run": nil}
    row = lambda df, **given: df.select(*[given.get(k, v).alias(k) for k, v in blank.items()])
    parts = row(reps, conv_id=F.col("conv_id"), copies=F.col("copies"), ends=F.when(F.col("n") == 0, F.col("ends")))
    if nodes is not None:
        parts = parts.unionByName(row(runs, leaf=F.col("leaf"), run=F.col("run"))).unionByName(row(nodes.where("place = 0"), kids=F.lit(1).cast("long")))
    out = parts.agg(
        F.min("conv_id").alias("conv_id"), F.sum("copies").alias("n_convs"), F.sum("kids").alias("n_children"), F.greatest(F.sum("leaf"), F.lit(1)).alias("n_leaves"),
        F.sum("run").alias("saved_tokens"), F.coalesce(F.max("ends"), F.lit(NOTHING)).alias("ends_sha256"),
    )
    return out.where("conv_id IS NOT NULL").withColumns({"depth": nil, "parent_conv_id": F.lit(None).cast("long")}).select(*COLUMNS)


def placed(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, chars) of every turn."""
    rows = turn_rows(conversations)
    return numbered(rows.select("conv_id", "turn", "role", "digest", F.length("text").cast("long").alias("chars"))).select("conv_id", "place", "digest", "chars")


def sizes(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count("*").alias("n"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations(conv_id, turn, role, text)``: a row for each distinct beginning.

    ``conv_id`` is its smallest member and ``depth`` its number of turns, which together name it;
    ``parent_conv_id`` names the node above; ``n_convs`` members, ``n_children``, ``n_leaves`` below
    it (itself if childless), ``saved_tokens`` of its subtree (each node's code points as often as
    it has further members), ``ends_sha256`` of the ids that end there.

    Defined cases: turns go by ``turn`` (null first), then role, then a digest of the text; null
    roles and texts are empty ones; rows without a conv_id are left out; a repeated row is a
    further turn; other columns are ignored; an empty table has no nodes.
    """
    turns = written(placed(conversations), "placed")
    return trie_of(turns, sizes(turns))


def with_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``nodes`` of :func:`prefix_trie` with ``role`` and ``text`` of their last turn (null for the root)."""
    turns = numbered(turn_rows(conversations)).select("conv_id", (F.col("place") + 1).alias("depth"), "role", "text")
    return nodes.join(turns, ["conv_id", "depth"], "left")


def grafted(turns: DataFrame, base: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, sizes) of conversations that begin as another one does.

    Conversation c takes the first h turns of c - c % ``base``, h being crc32(c) % ``most``,
    in place of its own first h.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % most
    n = sizes(turns).withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % base})
    own = n.select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    info = n.join(own, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    info = written(info.select("conv_id", "base", "n", "h", "taken"), "grafts")
    heads = turns.where((F.col("conv_id") % base == 0) & (F.col("place") < most - 1)).withColumnRenamed("conv_id", "base")
    front = info.select("conv_id", "base", "taken").join(heads, "base").where("place < taken").select(*turns.columns)
    back = by_blocks(turns, info.select("conv_id", "n", "h", "taken")).where("place >= h")
    back = back.withColumn("place", F.col("place") - F.col("h") + F.col("taken")).select(*turns.columns)
    return front.unionByName(back), info.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = grafted(written(placed(table(spark, sf_dir, "conversations")), "placed"))
    return trie_of(written(turns, "grafted"), convs)
