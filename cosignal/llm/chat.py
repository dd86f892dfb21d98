"""Chat formatting of reply trees.

Messages point to the message they answer. Iterative self-joins enumerate the root-to-leaf
paths by doubling: the table of 2^k-th ancestors joined with itself gives the 2^(k+1)-th,
and the set of (leaf, ancestor) pairs, joined with it, doubles the reach of every path. A
tree of depth d takes about log2(d) rounds, each written to the shared checkpoint folder;
only ids and scores take part. Branches are ranked by the sum of the scores on their path,
and each chosen branch is formatted as one conversation.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside texts and roles a
backslash is doubled and ``<|`` becomes ``<\\|``; a line break in a role becomes ``\\n``
(a backslash and an n), so the control strings occur only where the template put them and
everything can be read back. The loss mask is the list of spans of assistant texts.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cosignal.llm.common import column, stage

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """Undo ``escape_role``: between doubled backslashes only ``\\n`` and ``\\|`` occur."""
    parts = F.split(role, r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(
        F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))), "\\")


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, dist, score): every message ``node`` on the path of every leaf,
    ``dist`` replies above it, from (tree, node, parent, score) with unique (tree, node).

    A message whose parent is null or absent is a root. Messages below a cycle have no
    path. Rounds end once no message has an ancestor that far up.
    """
    m = stage(messages.select("tree", "node", "parent", "score"), "messages")
    known = m.select("tree", F.col("node").alias("parent"))
    hop = stage(m.select("tree", "node", "parent").join(known, ["tree", "parent"], "left_semi")
                .select("tree", "node", F.col("parent").alias("up")), "hops")
    leaves = m.join(hop.select("tree", F.col("up").alias("node")), ["tree", "node"], "left_anti")
    found = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("dist"))
    reach, total = 1, m.count()
    while not hop.isEmpty():
        if reach > total:       # an ancestor that far up can only be on a cycle
            endless = hop.select("tree", F.col("node").alias("leaf")).distinct()
            found = found.join(endless, ["tree", "leaf"], "left_anti")
            break
        step = hop.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "up")
        further = found.join(step, (found.tree == step._t) & (found.node == step._n)).select(
            "tree", "leaf", F.col("up").alias("node"), (F.col("dist") + reach).alias("dist"))
        found = stage(found.unionByName(further), "paths")
        left = hop.select("tree", "node", F.col("up").alias("_m"))
        hop = stage(left.join(step, (left.tree == step._t) & (left._m == step._n))
                    .select("tree", "node", "up"), "hops")
        reach *= 2
    return found.join(m.select("tree", "node", "score"), ["tree", "node"]).select(
        "tree", "leaf", "node", "dist", "score")


def rank_branches(on_paths: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, branch_score, branch_rank): the ``branches`` best leaves of every tree
    (None: all) by the sum of scores on their path, ties to the smaller leaf."""
    scored = on_paths.groupBy("tree", "leaf").agg(F.sum("score").alias("branch_score"))
    order = Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")
    ranked = scored.withColumn("branch_rank", F.row_number().over(order))
    return ranked if branches is None else ranked.filter(F.col("branch_rank") <= branches)


def format_trees(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree_id, leaf, branch_score, branch_rank, formatted, loss_spans): one row per chosen
    branch; ``loss_spans`` are (start, length) in code points of ``formatted``, from 0.

    ``messages`` has tree_id, msg_id, parent_id, role, text, score. Null roles and texts are
    empty, null scores 0, a null tree_id is a tree of its own. Rows without msg_id take no
    part. Rows that repeat a (tree_id, msg_id) count once, the smallest by (parent_id, role,
    text, score). An empty table gives no rows.
    """
    given = messages.select(
        column(messages, "tree_id", "long").alias("tree_id"),
        column(messages, "msg_id", "long").alias("node"),
        column(messages, "parent_id", "long").alias("parent"),
        F.coalesce(column(messages, "role", "string"), F.lit("")).alias("role"),
        F.coalesce(column(messages, "text", "string"), F.lit("")).alias("text"),
        F.coalesce(column(messages, "score", "double"), F.lit(0.0)).alias("score"),
    ).filter("node IS NOT NULL").withColumn("tree", F.coalesce(F.col("tree_id").cast("string"), F.lit("")))
    first = F.min(F.struct("parent", "role", "text", "score", "tree_id")).alias("m")
    m = stage(given.groupBy("tree", "node").agg(first).select("tree", "node", "m.*"), "turns")
    on_paths = stage(paths(m), "on-paths")
    chosen = rank_branches(on_paths, branches)
    piece = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END + "\n"))
    turns = (on_paths.select("tree", "leaf", "node", "dist").join(chosen, ["tree", "leaf"])
             .join(m.select("tree", "node", "role", "text", "tree_id"), ["tree", "node"])
             .withColumn("piece", piece))
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("dist")).rowsBetween(Window.unboundedPreceding, -1)
    start = (F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0))
             + len(START) + F.length(escape_role(F.col("role"))) + 1)
    turns = turns.withColumn("start", start.cast("long")).withColumn("span", F.when(
        F.col("role") == TRAINED_ROLE, F.struct("start", F.length(escape(F.col("text"))).cast("long").alias("length"))))
    # Smallest first: the farthest ancestor has the largest dist.
    own = F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("at"), "piece", "span"))).alias("own")
    return (turns.groupBy("tree", "leaf").agg(own, F.first("tree_id").alias("tree_id"),
                                              F.first("branch_score").alias("branch_score"),
                                              F.first("branch_rank").alias("branch_rank"))
            .select("tree_id", "leaf", "branch_score", "branch_rank",
                    F.array_join(F.transform("own", lambda t: t["piece"]), "").alias("formatted"),
                    F.filter(F.transform("own", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans")))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    blocks = F.split(formatted, r"<\|im_end\|>\n")
    turns = F.slice(blocks, 1, F.size(blocks) - 1)

    def turn(block: Column) -> Column:
        body = F.substr(block, F.lit(len(START) + 1))
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescape_role(role).alias("role"),
                        unescape(F.substr(body, F.length(role) + 2)).alias("text"))

    return F.transform(turns, turn)


def trained_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, end to end."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
