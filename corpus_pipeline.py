"""Corpus pipeline: quality rules, line dedup, SimHash near-dedup, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet in the shared checkpoint folder and read again as the next stage's documents. All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cosignal.llm import line_dedup, mixing, packing, quality, simhash
from cosignal.llm.common import read, stage
from cosignal.llm.queries import tokenizer_path
from cosignal.session import ensure_checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and the repetition rules."""
    return quality.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand on many sites, which stay in their first document."""
    return line_dedup.clean_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked SimHash fingerprints, the smallest doc_id."""
    return simhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: every document at least once, documents of small
    sources again as their budget asks, one row per copy."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all copies in sequences of at most 4096 tokens."""
    made = packing.pack(docs, str(tokenizer_path()))
    return made.select("doc.doc_id", *[c for c in made.columns if c != "doc"])


STAGES = [("quality rules", quality_rules), ("line dedup", dedup_lines), ("simhash near-dedup", near_dedup),
          ("mixing", mix_sources), ("packing", pack_sequences)]

#: SimHash, tokens and packing are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows."""
    ensure_checkpoint_dir(spark)
    docs = read(spark, sf_dir, "documents")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, name.replace(" ", "-"))
    return docs
