"""The registered queries of this subpackage: each applies one operator, with production
parameters, to its whole table and derives the reported columns from the real output."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cosignal.llm import (ann_tree, chat, fill_middle, langid, line_dedup, main_text, mixing, packing,
                          quality, secrets, simhash, url_rules, word_runs)
from cosignal.llm.common import read


def hex_sha256(text):
    return F.sha2(text.cast("binary"), 256)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind_no"] < len(secrets.BASE))
    return found.select(
        F.col("doc.doc_id").alias("doc_id"), *[of(k).alias(f"n_{k}") for k in secrets.BASE],
        hex_sha256(secrets.digest(base)).alias("base_sha256"),
        secrets.digest(F.col("spans")).alias("spans"))


#: The conversation of control strings that every run formats beside the table's own.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def conversation_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` plus conversation -1 as reply trees: each turn answers the one
    before it (order: turn, role, text; rows that repeat stay separate turns)."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rows.unionByName(control).withColumn("msg_id", F.row_number().over(order).cast("long"))
    return placed.select(
        F.col("conv_id").alias("tree_id"), "msg_id",
        F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text",
        F.lit(0.0).alias("score"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chat.format_trees(conversation_trees(spark, sf_dir))
    turns = chat.read_back(F.col("formatted"))
    each = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (made.select("tree_id", "formatted", turns.alias("turns"),
                        chat.trained_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
            .select(F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
                    hex_sha256(F.array_join(each, "")).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"),
                    hex_sha256(F.col("loss")).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars")))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixing.copies(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return made.select(F.col("doc.doc_id").alias("doc_id"), "source", "epoch", "order_key", "block",
                       "tokens", F.round("position", 9).alias("position"),
                       F.round("weight", 9).alias("weight"), F.round("alpha", 6).alias("alpha"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    prototypes = langid.learn(docs.filter("NOT held_out").select("text", "lang"))
    return (langid.predict(docs.select("doc_id", "held_out", "text"), prototypes, ["doc_id", "held_out"])
            .select("doc.doc_id", "doc.held_out", "lang_pred", "score"))


def op5_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_tree.search(read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = packing.pack(read(spark, sf_dir, "documents"), str(tokenizer_path()))
    return made.select("doc.doc_id", *[c for c in made.columns if c != "doc"])


URL_HOST_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
                  ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [*(url_rules.host_rule(*r) for r in URL_HOST_RULES), *url_rules.DEFAULT_PATTERNS]
    made = url_rules.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), rules)
    of_host = F.col("rule_rank") > 0
    return made.select("doc.page_id", "host", "path", F.when(of_host, F.col("rule")).alias("rule"),
                       F.col("action").alias("verdict"),
                       F.when(~of_host, F.col("rule")).alias("pattern_rule"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quality.judge(read(spark, sf_dir, "documents"), ["doc_id"])
    return made.select("doc.doc_id", *quality.COLUMNS)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = line_dedup.clean(read(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"),
                       hex_sha256(F.col("text")).alias("kept_sha256"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transform(read(spark, sf_dir, "documents"), ["doc_id"])
    kept = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"]
    back = fill_middle.restore(made.select("doc.doc_id", *kept[1:], "output"), kept, keep_text=False)
    return back.select(*kept, "restored_sha256")


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = main_text.extract_pages(read(spark, sf_dir, "pages"), ["page_id", "url"])
    return made.select("doc.page_id", "doc.url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks")


def planted_period(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document, periodic from some word on in about a tenth of them (a null id
    hashes as the empty string)."""
    h, n = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    whole, rest = divmod(n - a, p)
    return words[:a] + words[a:a + p] * whole + words[a:a + rest]


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = word_runs.detect(read(spark, sf_dir, "documents"), ["doc_id"], edit=planted_period, keep_text=False)
    return made.select("doc.doc_id", *[c for c in word_runs.COLUMNS if c != "n_words"])


QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_chat_format, op3_mix_sources, op4_language_id, op5_ann_tree, op6_simhash,
    op7_pack, op8_url_rules, op9_quality, op10_line_dedup, op11_fill_middle, op12_main_text,
    op13_word_runs)}
