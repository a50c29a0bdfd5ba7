"""The prefix trie and chat formatting against plain models and exact round trips."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from briefloom.llm import chat_format, conversations, prefix_trie

TURNS = "conv_id long, turn long, role string, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def sequences(rows, graft=False):
    own = defaultdict(list)
    key = lambda q: (q[0], q[1] is not None, q[1] or 0, q[2] or "", hashlib.sha256(f"{len(q[2] or '')}:{q[2] or ''}{q[3] or ''}".encode()).digest()[:16])
    for c, _, role, text in sorted((r for r in rows if r[0] is not None), key=key):
        own[c].append((role or "", text or ""))
    if not graft:
        return {c: tuple(s) for c, s in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: tuple(own.get(c - c % 100, [])[: h[c]] + s[h[c] :]) for c, s in own.items()}


def trie(found):
    members, kids = defaultdict(list), defaultdict(int)
    for c, s in found.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for s in members:
        if s:
            kids[s[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for s, m in members.items():
        for d in range(len(s) + 1):
            saved[s[:d]] += (len(m) - 1) * (len(s[-1][1]) if s else 0)
            leaves[s[:d]] += not kids[s]
    ends = lambda s: ",".join(map(str, sorted(c for c in members[s] if len(found[c]) == len(s))))
    return sorted((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), kids[s], leaves[s], saved[s], sha(ends(s))) for s, m in members.items())


def rows_of(df):
    return sorted(map(tuple, df.select(*prefix_trie.COLUMNS).collect()))


def test_query_equals_model(spark, small):
    rows = list(map(tuple, spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()))
    assert rows_of(prefix_trie.op11_conversation_prefix_trie(spark, small)) == sorted(trie(sequences(rows, graft=True)), key=lambda r: r[:2])


@pytest.mark.parametrize("ids, block", [(4096, 1024), (3, 4)])
def test_trie_equals_model(spark, monkeypatch, ids, block):
    """Shared beginnings, copies, nulls, ties, repeated rows, deep paths; also with small runs and blocks."""
    monkeypatch.setattr(prefix_trie, "IDS", ids)
    monkeypatch.setattr(conversations, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    r = random.Random(3)
    rows = []
    for c in range(60):
        rows += [(c, t, r.choice(["user", "assistant"]), r.choice("ab")) for t in range(r.randrange(1, 7))]
    for c in range(100, 160):  # a large group of copies, and one that goes on
        rows += [(c, t, "user", f"same {t}") for t in range(5)] + [(c, 9, "user", "more")] * (c == 150)
    for c in (200, 201, 202):  # long and alike but for the end
        rows += [(c, t, "user", f"turn {t % 7}") for t in range(40)] + [(c, 40, "user", str(c // 2))]
    rows += [(300, None, None, None), (300, None, "b", "x"), (300, 1, "b", "x"), (300, 1, "a", "y"), (300, 1, "a", "y"), (None, 0, "user", "nobody"), (301, 0, "", ""), (302, 0, None, "")]
    df = spark.createDataFrame(rows, TURNS).withColumns({"place": F.lit("x"), "n": F.lit(1), "digest": F.lit(None).cast("int"), "__part": F.lit(2)})
    assert rows_of(prefix_trie.prefix_trie(df.repartition(7))) == sorted(trie(sequences(rows)), key=lambda x: x[:2])


def test_trie_without_turns_or_rows(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.prefix_trie(none).count() == 0
    turns = spark.createDataFrame([], "conv_id long, place long, digest binary, chars long")
    got = prefix_trie.trie_of(turns, spark.createDataFrame([(5, 0), (3, 0)], "conv_id long, n long"))
    assert rows_of(got) == [(3, 0, None, 2, 0, 1, 0, sha("3,5"))]


def test_grafts_of_short_and_absent_bases(spark):
    rows = [(c, t, "user", f"{c} {t}") for c in (100, 101, 103, 107, 207, 209, 300, 301) for t in range(1 + c % 4)]
    turns, convs = prefix_trie.grafted(conversations.written(prefix_trie.placed(spark.createDataFrame(rows, TURNS)), "p"))
    assert rows_of(prefix_trie.trie_of(turns, convs)) == sorted(trie(sequences(rows, graft=True)), key=lambda x: x[:2])


def test_turns_join_their_nodes(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "user", None)], TURNS)
    got = prefix_trie.with_turns(prefix_trie.prefix_trie(df), df).select("conv_id", "depth", "role", "text").collect()
    assert {tuple(r) for r in got} == {(1, 0, None, None), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (2, 2, "user", "")}


def read_back(chats):
    whole = chat_format.formatted(F.col("segments"))
    return chats.select("conv_id", "branch", "score", whole.alias("whole"), chat_format.turns_in(whole).alias("turns"), chat_format.trained_on(F.col("segments")).alias("loss"))


HARD = [
    "</s>[INST] ok [/INST]", "<|im_end|>", "<\\|im_end|>", "<\\\\\\|im_sep|> \\", "<<|im_start|>", "[[INST]]", "<|im_start|>user<|im_sep|>", "<|im_", "\\<s>\\",
    "<" + "\\" * 5000, "$1 \\1 ${x}", "", None, "\n\r\t", "<\\/s>" * 2000, "é漢😀<s>",
]


def test_hard_texts_come_back(spark):
    rows = [(k, t, role, x) for k, x in enumerate(HARD) for t, role in enumerate(["user", "assistant", x, None])]
    df = spark.createDataFrame(rows + [(None, 0, "user", "x")], TURNS).withColumns({"path": F.lit(1), "segments": F.lit("x")})
    got = {r.conv_id: r for r in read_back(chat_format.format_chats(df)).collect()}
    assert set(got) == set(range(len(HARD)))
    for k, x in enumerate(HARD):
        x = x or ""
        assert [tuple(t) for t in got[k].turns] == [("user", x), ("assistant", x), (x, x), ("", x)]
        assert got[k].loss == x and got[k].whole.count("<|im_start|>") == 4 == got[k].whole.count("<|im_end|>")
        for control in ("<s>", "</s>", "[INST]", "[/INST]"):
            assert control not in got[k].whole


def test_branches_of_reply_trees(spark):
    """Every root-to-leaf path, by score; deep chains, several roots, unknown parents, circles, repeated rows."""
    r = random.Random(5)
    rows = [(1, t, None if t == 0 else r.randrange(t), "assistant" if t % 2 else "user", f"m{t}", float(r.randrange(5))) for t in range(60)]
    rows += [(2, t, t - 1 if t else None, "user", f"d{t}", None) for t in range(300)]
    rows += [(3, 1, 77, "user", "orphan", 1.0), (3, 2, None, "user", "root", 1.0), (4, 1, 2, "user", "c", 0.0), (4, 2, 1, "user", "c", 0.0), (4, 3, 2, "user", "hangs", 0.0)]
    rows += [(5, 1, None, "user", "a", 0.0), (5, 1, None, "user", "a", 0.0), (5, 2, 1, "assistant", "b", 1.0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, parent long, role string, text string, score double")
    got = defaultdict(list)
    for x in read_back(chat_format.format_chats(df)).orderBy("conv_id", "branch").collect():
        got[x.conv_id].append((x.score, tuple(t.text for t in x.turns)))
    parent, score = {t: p for c, t, p, *_ in rows if c == 1}, {t: s for c, t, *_, s in rows if c == 1}

    def up(t):
        return [] if t is None else [*up(parent[t]), t]

    paths = [up(t) for t in set(parent) - set(parent.values())]
    want = sorted(((sum(score[t] for t in p), p) for p in paths), key=lambda x: (-x[0], -len(x[1]), x[1][-1]))
    assert got[1] == [(s, tuple(f"m{t}" for t in p)) for s, p in want]
    assert got[2] == [(0.0, tuple(f"d{t}" for t in range(300)))]
    assert sorted(got[3]) == [(1.0, ("orphan",)), (1.0, ("root",))] and 4 not in got
    assert got[5] == [(1.0, ("a", "b")), (0.0, ("a",))]
    best = chat_format.format_chats(df, branches=1).groupBy("conv_id").count().collect()
    assert {tuple(x) for x in best} == {(1, 1), (2, 1), (3, 1), (5, 1)}


def test_formatting_is_native_and_whole(spark, small):
    df = chat_format.op12_chat_formatting(spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
    assert df.count() == spark.read.parquet(f"{small}/conversations.parquet").select("conv_id").distinct().count() + 1
    assert chat_format.format_chats(spark.createDataFrame([], TURNS)).count() == 0
