"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power alpha, normalised. Alpha = 1 keeps the
shares, smaller values flatten them. Alpha is bisected: the largest alpha whose weights
reach the target entropy, raised where needed to the smallest that keeps every source
within the repetition limit. Budgets follow from the weights: with the total chosen so that
no source has less than one pass, nothing is dropped and small sources repeat.

The budgets are realised as block permutations. In every pass a source's documents are
ordered by a hash of pass and document, which cuts the pass into blocks of the hash range;
whole blocks are admitted until the budget's cut block, and only inside that block are
documents counted one by one. So no task orders a whole source, however hot.

DataFrame operations only. The driver sees single numbers, never a list of sources.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cosignal.llm.common import column, shuffle_partitions, stage

MAX_PASSES = 2.0        # repetition limit: passes over a source, against the least repeated
TARGET_ENTROPY = 0.97   # wanted entropy of the weights, as a share of the largest possible
BLOCK_DOCS = 1024       # documents wanted in a block
PARTITION_ROWS = 20_000 # rows of the mixture a partition is meant to hold
STEPS = 40              # halvings of the bisection
LEVELS = 4              # halvings that one pass over the sources decides
MIX_SEED = "mix"


def words(text: Column) -> Column:
    """Tokens of a text: its blank-separated words."""
    return F.when(F.trim(text, F.lit(" \t\n\x0b\x0c\r")) == "", 0).otherwise(
        F.size(F.split(F.trim(text, F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+"))).cast("long")


def bisect(sources: DataFrame, good, low: float, high: float, steps: int = STEPS) -> float:
    """The upper end of an interval in [low, high] that 2^-steps of it wide, in which
    ``good(alpha)`` (an aggregate over ``sources``, as a Column) changes from true to false
    with rising alpha. Each pass over ``sources`` evaluates the midpoints of ``LEVELS``
    halvings at once and so decides that many steps."""
    for _ in range(0, steps, LEVELS):
        n = 2 ** LEVELS
        points = [low + (high - low) * i / n for i in range(1, n)]
        row = sources.agg(*[good(p).alias(f"p{i}") for i, p in enumerate(points)]).first()
        holds = [low, *[p for i, p in enumerate(points) if row[i]]][-1]
        low, high = holds, min([p for p in [*points, high] if p > holds])
    return low


def fit_alpha(sources: DataFrame, target_entropy: float = TARGET_ENTROPY,
              max_passes: float = MAX_PASSES) -> float:
    """Alpha for the table ``sources`` (source, tokens > 0), rounded to 6 digits upwards so
    that the repetition limit holds. 1.0 for fewer than two sources."""
    n, total = sources.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    if n < 2:
        return 1.0
    share = F.col("tokens") / F.lit(total)
    wanted = target_entropy * math.log(n)

    def entropy_reached(alpha: float) -> Column:
        power = F.pow(share, F.lit(alpha))
        mass = F.sum(power)
        return F.log(mass) - alpha * F.sum(power * F.log(share)) / mass >= wanted

    def too_often(alpha: float) -> Column:
        # Passes are tokens^(alpha - 1) up to a factor, so the rarest source has the most.
        return F.pow(F.max("tokens") / F.min("tokens"), F.lit(1 - alpha)) > max_passes

    # Both hold up to some alpha and not beyond, so the larger of the two is where neither does.
    found = bisect(sources, lambda alpha: entropy_reached(alpha) | too_often(alpha), 0.0, 1.0)
    return min(1.0, math.ceil(found * 1e6) / 1e6)


def plan_sources(tokens: DataFrame, target_entropy: float = TARGET_ENTROPY,
                 max_passes: float = MAX_PASSES) -> tuple[DataFrame, float]:
    """((source, tokens, docs, weight, budget, passes, rest), alpha) from a stored table
    (source, tokens): ``budget`` tokens are ``passes`` whole passes and ``rest`` tokens."""
    sources = stage(tokens.groupBy("source").agg(F.sum("tokens").cast("long").alias("tokens"),
                                                 F.count(F.lit(1)).alias("docs")), "sources")
    live = sources.filter("tokens > 0")
    alpha = fit_alpha(live, target_entropy, max_passes)
    total = live.agg(F.sum("tokens")).first()[0] or 1
    power = F.pow(F.col("tokens") / F.lit(total), F.lit(alpha))
    mass, most = live.agg(F.sum(power), F.max(F.col("tokens") / power)).first()
    # The total budget at which the least repeated source has exactly one pass.
    budget = F.greatest(F.col("tokens"), F.floor(power * F.lit(most or 1.0) + 1e-6))
    planned = sources.select(
        "source", "tokens", "docs", F.when(F.col("tokens") > 0, power / F.lit(mass or 1.0))
        .otherwise(0.0).alias("weight"),
        F.when(F.col("tokens") > 0, budget).otherwise(0).cast("long").alias("budget"))
    return planned.withColumns({
        # A source without tokens still has its (empty) documents once.
        "passes": F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(1),
        "rest": F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0)}), alpha


def order_key(epoch: Column, source: Column, doc_id: Column) -> Column:
    """Hex key that orders a source's documents within a pass."""
    return F.md5(F.concat_ws("|", F.lit(MIX_SEED), epoch.cast("string"),
                             F.coalesce(source, F.lit("")), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _fraction(key: Column) -> Column:
    """A hex key's place in [0, 1): its first 32 bits."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)


def cuts(tokens: DataFrame, planned: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(source, cut): the last order key that the partial pass still admits, null if none.
    ``tokens`` is a stored table (doc_id, source, tokens)."""
    partial = planned.filter("rest > 0").select(
        F.col("source").alias("_s"), "passes", "rest",
        F.ceil(F.col("docs") / block_docs).alias("blocks"))
    key = order_key(F.col("passes"), F.col("source"), F.col("doc_id"))
    at = (tokens.join(partial, F.col("source").eqNullSafe(F.col("_s")))
          .select("source", "tokens", "rest", key.alias("key"), "blocks")
          .withColumn("block", F.floor(_fraction(F.col("key")) * F.col("blocks"))))
    sums = at.groupBy("source", "block").agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"))
    before = F.sum("t").over(Window.partitionBy("source").orderBy("block")) - F.col("t")
    cut = (sums.withColumn("before", before)
           .filter("before <= rest AND rest < before + t")
           .select(F.col("source").alias("_s"), F.col("block").alias("_b"), "before"))
    inside = (at.join(cut, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
              .groupBy("source", "key", "rest", "before").agg(F.sum("tokens").alias("t")))
    running = F.col("before") + F.sum("t").over(Window.partitionBy("source").orderBy("key"))
    admitted = (inside.withColumn("running", running).filter("running <= rest")
                .groupBy("source").agg(F.max("key").alias("last")))
    # Where the cut block admits nothing, every earlier block still does.
    edge = cut.join(planned.select(F.col("source").alias("_p"), F.ceil(F.col("docs") / block_docs).alias("blocks")),
                    F.col("_s").eqNullSafe(F.col("_p"))).select("_s", "_b", "blocks")
    return (edge.join(admitted, F.col("_s").eqNullSafe(F.col("source")), "left")
            .select(F.col("_s").alias("cut_source"), F.col("_b").alias("cut_block"), "blocks",
                    F.col("last").alias("cut_key")))


def copies(docs: DataFrame, source: str = "source", target_entropy: float = TARGET_ENTROPY,
           max_passes: float = MAX_PASSES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The mixture: every input column in struct ``doc``, then epoch (0..), order_key,
    position (0 <= position < 1: sorting by it deals the sources evenly over the run),
    block (of its source in that epoch), tokens, weight and alpha.

    Every row occurs once per whole pass of its source and, in the partial pass, if its key
    is within the budget, which is never exceeded. Null sources are one source; null, empty
    and blank texts have no tokens; rows with the same source and doc_id (repeated rows)
    share their key and are admitted together; an empty table gives no rows; with one source
    every row occurs once.
    """
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"),
                      column(docs, "doc_id", "string").alias("doc_id"),
                      column(docs, source, "string").alias("source"),
                      F.coalesce(words(column(docs, "text", "string")), F.lit(0)).cast("long").alias("tokens"))
    tokens = stage(own.select("doc_id", "source", "tokens"), "tokens")
    planned, alpha = plan_sources(tokens, target_entropy, max_passes)
    planned = stage(planned, "mix-plan")
    edge = cuts(tokens, planned, block_docs)
    full = stage(planned.join(edge, F.col("source").eqNullSafe(F.col("cut_source")), "left").select(
        F.col("source").alias("_s"), F.col("tokens").alias("_t"), "weight", "budget", "passes",
        F.ceil(F.col("docs") / block_docs).alias("_blocks"), "cut_block", "cut_key"), "mix-cuts")
    epochs = F.explode(F.sequence(F.lit(0), F.col("passes").cast("int"))).alias("epoch")
    met = own.join(full, F.col("source").eqNullSafe(F.col("_s")))
    dealt = met.select("*", epochs).withColumn(
        "order_key", order_key(F.col("epoch"), F.col("source"), F.col("doc_id")))
    dealt = dealt.withColumn("block", F.floor(_fraction(F.col("order_key")) * F.col("_blocks")))
    admitted = ((F.col("epoch") < F.col("passes")) | (F.col("block") < F.col("cut_block"))
                | ((F.col("block") == F.col("cut_block")) & (F.col("order_key") <= F.col("cut_key"))))
    spans = F.greatest(F.lit(1.0), F.col("budget") / F.greatest(F.col("_t"), F.lit(1)))
    return (dealt.filter(F.coalesce(admitted, F.lit(False)))
            .select("doc", "doc_id", "source", "epoch", "order_key",
                    F.least((F.col("epoch") + _fraction(F.col("order_key"))) / spans,
                            F.lit(1 - 1e-9)).alias("position"),
                    F.col("block").cast("long").alias("block"), "tokens", "weight",
                    F.lit(alpha).alias("alpha")))


def mix_documents(docs: DataFrame, source: str = "source", **limits) -> DataFrame:
    """The mixture's rows, a row per copy, with exactly the columns of ``docs``, in the order of
    the mixture's permutation: every partition (their number follows from the rows) holds some ranges of positions, sorted, and so
    does every file written from it. Positions are spread evenly over [0, 1), so equal ranges
    are about equal in rows, and rows of any one source are dealt over all of them."""
    made = copies(docs, source, **limits)
    # At most about max_passes copies a row; four ranges a partition even out their hashes.
    rows = docs.count() * limits.get("max_passes", MAX_PASSES)
    parts = max(shuffle_partitions(docs.sparkSession), math.ceil(rows / PARTITION_ROWS))
    return (made.select("doc", "position", "order_key", F.floor(F.col("position") * (4 * parts)).alias("range"))
            .repartition(parts, "range").sortWithinPartitions("range", "position", "order_key").select("doc.*"))
