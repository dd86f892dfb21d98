"""Line dedup by distinct-site spread.

A line that stands on many different sites is boilerplate. Every line is reduced to a
128-bit hash; one aggregation merges a HyperLogLog sketch of the sites of each line hash
(partial sketches first, so a line on a third of all rows costs one sketch per task). Lines
whose estimate is far from the threshold are decided by it; lines near the threshold get
exact distinct counts. Boilerplate lines are then removed everywhere but in their first
document (the smallest doc_id), so the text of a document that was merely copied survives
once.

DataFrame operations only. Lines travel as hashes; texts are shuffled once, to meet the
numbers of the lines they lose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cosignal.llm.common import BLANKS, column, stage

MIN_SITES = 6       # a line on at least so many sites is boilerplate
SKETCH = 12         # log2 of the sketch's slots: standard error about 1.04 / sqrt(2^SKETCH)
MARGIN = 0.08       # estimates within this share of the threshold (and within 1) are near


def _text_key(text: Column) -> Column:
    return F.xxhash64(text)


def lines_of(docs: DataFrame, site: str = "source") -> DataFrame:
    """(doc_id, text_key, site, pos, h1, h2): every line with a word. A line counts by its
    text without blanks at both ends."""
    line = F.trim(F.col("_l"), F.lit(BLANKS))
    given = docs.select(column(docs, "doc_id", "long").alias("doc_id"),
                        column(docs, site, "string").alias("site"),
                        column(docs, "text", "string").alias("_t"))
    return (given.select("doc_id", "site", _text_key(F.col("_t")).alias("text_key"),
                         F.posexplode(F.split("_t", "\n")).alias("pos", "_l"))
            .withColumn("_l", line).filter("_l <> ''")
            .select("doc_id", "text_key", "site", "pos", F.xxhash64("_l").alias("h1"),
                    F.xxhash64(F.lit(1), F.col("_l")).alias("h2")))


def spread(lines: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """(h1, h2, home): the lines on at least ``min_sites`` distinct non-null sites, with the
    smallest doc_id that has them. ``lines`` should be a stored table: it is read twice."""
    sketched = stage(lines.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("home"), F.count(F.lit(1)).alias("n"),
        F.hll_sketch_agg("site", F.lit(SKETCH)).alias("sketch"))
        .filter(F.col("n") >= min_sites)     # fewer occurrences cannot be on more sites
        .select("h1", "h2", "home", F.hll_sketch_estimate("sketch").alias("sites")), "spread")
    slack = max(1.0, margin * min_sites)
    near = sketched.filter(F.abs(F.col("sites") - min_sites) <= slack)
    counted = (lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi")
               .filter("site IS NOT NULL")
               .groupBy("h1", "h2").agg(F.count_distinct("site").alias("exact"))
               .filter(F.col("exact") >= min_sites))
    sure = sketched.filter(F.col("sites") > min_sites + slack).select("h1", "h2", "home")
    return sure.unionByName(near.join(counted, ["h1", "h2"]).select("h1", "h2", "home"))


def clean(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with ``text`` free of boilerplate lines, all other columns as they are, plus
    ``n_lines`` (lines with a word) and ``n_removed``; existing columns of these two names
    are replaced.

    Null texts stay null; empty texts and blank lines are never touched; a null site is no
    site, but its rows are cleaned too; rows with a null doc_id are a line's home only if
    all its documents have none. Repeated rows are cleaned alike: rows that share the home's
    doc_id all keep the line. An empty table gives no rows.
    """
    lines = stage(lines_of(docs, site), "lines")
    boilerplate = stage(spread(lines, min_sites), "boilerplate")
    hits = (lines.join(boilerplate, ["h1", "h2"])
            .filter(~F.col("doc_id").eqNullSafe(F.col("home"))))
    # Keys of a document: its id and its text, so repeated rows share their removals.
    drops = (hits.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("_drop"))
             .withColumnsRenamed({"doc_id": "_id", "text_key": "_key"}))
    own = docs.drop("n_lines", "n_removed").withColumns(
        {"_doc": column(docs, "doc_id", "long"), "_text_key": _text_key(column(docs, "text", "string"))})
    met = own.join(drops, own["_doc"].eqNullSafe(drops["_id"]) & (own["_text_key"] == drops["_key"]), "left")
    all_lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), "_drop")
    text = F.when(F.col("_drop").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(all_lines, i)), "\n"))
    n_lines = F.coalesce(F.size(F.filter(all_lines, lambda l: F.trim(l, F.lit(BLANKS)) != "")), F.lit(0))
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return met.select(*[text.alias(c) if c == "text" else F.col(c) for c in keep],
                      F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
                      F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_removed"))


def clean_documents(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Cleaned rows with exactly the columns of ``docs`` (``n_chars`` follows the new text,
    if present). A document that lost all its words is dropped; every line it had stays in
    the line's first document."""
    found = clean(docs, site, min_sites)
    blank = F.trim("text", F.lit(BLANKS)) == ""
    found = found.filter((F.col("n_removed") == 0) | ~blank)
    length = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} \
        if "n_chars" in docs.columns else {}
    return found.select(*[length.get(c, F.col(c)).alias(c) for c in docs.columns])
