"""Chat formatting in DataFrame expressions only.

Messages form reply trees: each answers another one of its conversation, or none.  Root-to-leaf
paths are enumerated by iterative self-joins on the message answered, doubling the distance at
each join, over places alone; branches are ranked by the scores along them, and each chosen one
becomes one conversation in the template, with the assistant's texts as its loss mask.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>`` a turn.  Control strings inside roles and
texts get a backslash after their first character, one more than they have there already, so
that none is left and taking one away gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from briefloom.llm.common import dropped, table, written
from briefloom.llm.conversations import ORDER, numbered, turn_rows

#: The marks of the template, and what else tokenizers of chat models read as control.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = r"\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|/?SYS>>?"
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    """``text`` without any control string; :func:`unescaped` takes it back."""
    return F.regexp_replace(text, rf"([<\[])(\\*+)(?={CONTROL})", r"$1$2\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*+)(?={CONTROL})", "$1$2")


def reply_paths(messages: DataFrame) -> DataFrame:
    """(conv_id, leaf, place, up) of ``messages(conv_id, place, parent)``: the places from each leaf up to its root.

    ``up`` counts from the leaf.  Round k joins every path so far with the ancestors 2**k above;
    rounds grow with the logarithm of the deepest tree.  Messages whose parents run in a
    circle reach no root, and stand on no path.
    """
    leaves = messages.join(messages.select("conv_id", F.col("parent").alias("place")).distinct(), ["conv_id", "place"], "left_anti")
    paths = written(leaves.select("conv_id", F.col("place").alias("leaf"), "place", F.lit(0).cast("long").alias("up")), "paths")
    jumps = written(messages.where("parent IS NOT NULL").select("conv_id", "place", F.col("parent").alias("to")), "jumps")
    most = messages.agg(F.max("place")).first()[0] or 0
    step = 1
    while step <= most and not jumps.isEmpty():
        # the newest half of each path meets every ancestor at a distance of step
        more = paths.join(jumps, ["conv_id", "place"]).select("conv_id", "leaf", F.col("to").alias("place"), (F.col("up") + step).alias("up"))
        longer = written(paths.unionByName(more), "paths")
        above = jumps.select("conv_id", F.col("place").alias("mid"), "to")
        further = written(jumps.withColumnRenamed("to", "mid").join(above, ["conv_id", "mid"]).select("conv_id", "place", "to"), "jumps")
        dropped(paths)
        dropped(jumps)
        paths, jumps, step = longer, further, 2 * step
    rooted = paths.join(messages.where("parent IS NULL").select("conv_id", "place"), ["conv_id", "place"], "left_semi").select("conv_id", "leaf")
    return paths.join(rooted, ["conv_id", "leaf"], "left_semi")


def branches_of(messages: DataFrame) -> DataFrame:
    """(conv_id, branch, path, score): each leaf's path of places from the root, ranked by score within its conversation.

    The score is the sum of the messages' ``score`` along the path; ties go to the longer path, then to the earlier leaf.
    """
    paths = reply_paths(messages.select("conv_id", "place", "parent")).join(messages.select("conv_id", "place", "score"), ["conv_id", "place"])
    whole = paths.groupBy("conv_id", "leaf").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("up", "place")), False), lambda x: x["place"]).alias("path"), F.sum("score").alias("score")
    )
    order = Window.partitionBy("conv_id").orderBy(F.desc("score"), F.desc(F.size("path")), "leaf")
    return whole.withColumn("branch", F.row_number().over(order).cast("long")).select("conv_id", "branch", "path", "score")


def format_chats(conversations: DataFrame, branches: int | None = None) -> DataFrame:
    """One row for each chosen branch: conv_id, branch, score and ``segments``, an array of (text, loss).

    The formatted conversation is the segments' texts end to end; ``loss`` marks those that are
    trained on, the assistant's texts (without the template's marks).  ``conversations`` has
    conv_id, turn, role and text, and may have ``parent``, the turn that a message answers
    (without that column each answers the one before it), and ``score``, summed along a branch
    (nulls, and a missing column, count 0).  ``branches`` of a conversation are kept, by rank; None keeps all.

    Defined cases: turns go by ``turn`` (null first), then role, then a digest of the text; null
    roles and texts are empty; a turn that several messages have is answered at its first one;
    a parent that isn't there is none, and the message a root; rows without a conv_id are left
    out; other columns are ignored; an empty table gives no rows.  A conversation is one row of
    the result, so its text has to fit one.
    """
    given = conversations.columns
    to = F.col("parent").cast("long") if "parent" in given else F.lit(None).cast("long")
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0)) if "score" in given else F.lit(0.0)
    rows = turn_rows(conversations, to=to, score=score)
    order = [*ORDER, "to", "score"]
    messages = numbered(rows.select("conv_id", *order), order=order)
    if "parent" in given:
        first = messages.groupBy("conv_id", F.col("turn").alias("to")).agg(F.min("place").alias("parent"))
        messages = messages.join(first, ["conv_id", "to"], "left")
    else:
        messages = messages.withColumn("parent", F.when(F.col("place") > 0, F.col("place") - 1))
    chosen = branches_of(written(messages.select("conv_id", "place", "parent", "score"), "messages"))
    if branches is not None:
        chosen = chosen.where(F.col("branch") <= branches)

    trained = F.col("role") == TRAINED
    head = F.concat(F.lit(START), escaped(F.col("role")), F.lit(SEP))
    turn = F.struct(*order, head.alias("head"), escaped(F.col("text")).alias("body"), trained.alias("loss"))
    said = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("said"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)

    def laid(place: Column) -> Column:
        one = F.col("said")[place.cast("int")]
        return F.array(segment(one["head"], no), segment(one["body"], one["loss"]), segment(F.lit(END), no))

    return said.join(chosen, "conv_id").select("conv_id", "branch", "score", F.flatten(F.transform("path", laid)).alias("segments"))


def formatted(segments: Column) -> Column:
    """The conversation as one text."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def turns_in(text: Column) -> Column:
    """(role, text) of the turns of a formatted conversation."""
    parts = F.filter(F.split(text, r"<\|im_start\|>", -1), lambda _, k: k > 0)

    def read(part: Column) -> Column:
        role = F.substring_index(part, SEP, 1)
        body = F.substring_index(F.substring_index(part, SEP, -1), END, 1)
        return F.struct(unescaped(role).alias("role"), unescaped(body).alias("text"))

    return F.transform(parts, read)


def trained_on(segments: Column) -> Column:
    """The texts under the loss mask, unescaped, end to end."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    two = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text")
    )
    chats = format_chats(given.unionByName(two), branches=1)
    read = chats.select("conv_id", formatted(F.col("segments")).alias("whole"), trained_on(F.col("segments")).alias("loss"))
    turns = read.withColumn("turns", turns_in(F.col("whole")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("whole").cast("long").alias("formatted_chars"),
    )
