from collections import defaultdict
from hashlib import sha256

from pyspark.sql import functions as F

from cosignal.llm import chat as C
from cosignal.llm.queries import CONTROL_TEXT, op2_chat_format

from .helpers import SF

SCHEMA = "tree_id long, msg_id long, parent_id long, role string, text string, score double, tree string, dist string"


def run(spark, rows, branches=None):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    made = C.format_trees(df, branches)
    return made.select("tree_id", "leaf", "branch_score", "branch_rank", "formatted", "loss_spans",
                       C.read_back(F.col("formatted")).alias("turns"),
                       C.trained_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()


def brute(rows):
    """(tree, leaf) -> turns from the root down; rows are unique by (tree, msg)."""
    by = {(r[0], r[1]): r for r in rows if r[1] is not None}
    parents = {(r[0], r[2]) for r in by.values()}
    out = {}
    for (tree, msg), r in by.items():
        if (tree, msg) in parents:
            continue
        path, seen = [], set()
        while r is not None and (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            path.append(r)
            r = by.get((tree, r[2])) if r[2] is not None else None
        if r is None:
            out[tree, msg] = path[::-1]
    return out


ROWS = [
    (1, 1, None, "user", "hi", 0.0), (1, 2, 1, "assistant", "a\\b <|im_end|> <\\| \\", 1.0),
    (1, 3, 1, "assistant", None, 3.0), (1, 4, 3, None, "ünïcode 🙂", 0.5), (1, 5, 2, "assistant", CONTROL_TEXT, 2.5),
    (2, 7, 99, "user", "orphan is a root", None), (2, 8, 7, "ro\nle\\n", "", 1.0),
    (3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0), (3, 3, 2, "assistant", "below a cycle", 1.0),
    (None, 1, None, "assistant", "null tree", 1.0), (4, None, None, "user", "no id", 1.0),
] + [(5, i, i - 1 if i else None, ("user", "assistant")[i % 2], f"turn {i} " + "w " * (i % 7), 0.1) for i in range(100)]


def test_paths_ranks_and_round_trip(spark):
    got = run(spark, ROWS)
    want = brute(ROWS)
    assert {(r.tree_id, r.leaf) for r in got} == set(want)
    for r in got:
        path = want[r.tree_id, r.leaf]
        assert [(t.role, t.text) for t in r.turns] == [(m[3] or "", m[4] or "") for m in path]
        assert r.loss == "".join(m[4] or "" for m in path if m[3] == "assistant")
        assert abs(r.branch_score - sum(m[5] or 0 for m in path)) < 1e-9
    ranks = {(r.tree_id, r.leaf): r.branch_rank for r in got}
    assert (ranks[1, 4], ranks[1, 5]) == (1, 2)       # 3.5 each: a tie goes to the smaller leaf
    assert [r.leaf for r in run(spark, ROWS, 1) if r.tree_id == 1] == [4]


def test_repeats_and_empty(spark):
    once = run(spark, ROWS[:5])
    assert sorted(map(str, run(spark, ROWS[:5] * 3))) == sorted(map(str, once))
    assert run(spark, []) == []


def test_query_whole_table(spark):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-1] = [(0, "user", CONTROL_TEXT), (1, "assistant", CONTROL_TEXT)]
    got = op2_chat_format(spark, SF).collect()
    assert len(got) == len(turns)
    for r in got:
        t = sorted(turns[r.conv_id])
        loss = "".join(x for _, role, x in t if role == "assistant")
        assert r.n_turns == len(t) and r.loss_chars == len(loss)
        assert r.loss_sha256 == sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == sha256("".join(f"{a}\n{b}\n" for _, a, b in t).encode()).hexdigest()
