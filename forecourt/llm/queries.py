"""The named queries: each applies one operator to its whole table and returns its digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.llm import (
    chat_log, decontamination, merge_bpe, periodic_runs, prefix_trie, quality_rules, sharding, simhash, site_templates, suffix_dedup, token_files,
    toxicity, url_rules,
)
from forecourt.llm.common import SPACE_RUN, as_text, table, written

#: Host, path and verdict of the URL rules.
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def site_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return site_templates.extract_pages(pages).select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


#: Turns of conversation -1, whose texts are control strings of a template.
CONTROL_TURNS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn long, role string, text string")
    return chat_log.write_and_read(rows.unionByName(own))


def ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("row.doc_id", "severity", "grade", "toxic")


def huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.write_and_read(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2).withColumnRenamed("key", "doc_id")


def merge_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return merge_bpe.round_trips(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("key", "doc_id")


def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select(F.col("key").alias("doc_id"), simhash.hex_digits("fingerprint").alias("fingerprint"),
                        F.col("component").alias("component_id"))


def sharding_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = sharding.assign_shards(docs, shards=40)
    return placed.select("row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def quality_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge_texts(docs).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_passages(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(F.col("key").alias("doc_id"), "n_words", "n_hit", "n_items",
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def url_prefix_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(pages, rules).select("row.page_id", "host", "path", "rule", "verdict")


def with_periods(docs: DataFrame) -> DataFrame:
    """``docs`` in which each document with crc32(doc_id) % 10 = 0 repeats a stretch of its words from some word on to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.filter(F.split(as_text(F.col("text")), SPACE_RUN, -1), lambda w: w != ""))
    g, n = F.floor(h / 10), F.nullif(F.size("words").cast("long"), F.lit(0))
    cut = docs.select("doc_id", "text", g.alias("g"), words.alias("words")).withColumn("a", F.col("g") % n)
    cut = cut.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform("words", lambda w, i: F.when(i >= F.col("a"), F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))).otherwise(w))
    return cut.select("doc_id", F.coalesce(F.when(F.col("a").isNotNull(), F.array_join(again, " ")), "text").alias("text"))


def word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_periods(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.select("row.doc_id", "runs", longest.alias("best"), "collapsed", F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
                       F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256"))


def passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["begin"])
    return found.select("row.doc_id", "n_bytes", size.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def rebuilt(lists: DataFrame) -> DataFrame:
    """Turn lists in which each conversation begins with up to three turns of the last whose id divides by 20."""
    lists = written(lists, "turn-lists")
    heads = lists.where("conv % 20 = 0").select(F.col("conv").alias("base"), F.slice("turns", 1, 3).alias("head"))
    h = (F.crc32(F.col("conv").cast("string")) % 4).cast("int")
    begins = F.coalesce(F.slice("head", 1, h), F.slice("turns", 1, 0))
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return lists.join(heads, F.expr("conv - conv % 20 = base"), "left").select("conv", F.concat(begins, own).alias("turns"))


def conversation_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie.conversation_trie(rebuilt(prefix_trie.turn_lists(table(spark, sf_dir, "conversations"))))
    return nodes.select(F.col("first").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent_first").alias("parent_conv_id"),
                        "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES = {
    "op1_site_templates": site_template_removal,
    "op2_chat_event_log": chat_formatting,
    "op3_ordinal_toxicity": ordinal_toxicity,
    "op4_huffman_token_files": huffman_token_files,
    "op5_merge_encoding": merge_encoding,
    "op6_simhash_bit_sliced": simhash_components,
    "op7_best_fit_sharding": sharding_best_fit,
    "op8_quality_rules": quality_rule_table,
    "op9_positional_index": benchmark_passages,
    "op10_url_rules": url_prefix_rules,
    "op11_periodic_runs": word_runs,
    "op12_suffix_dedup": passage_dedup,
    "op13_prefix_trie": conversation_prefixes,
}
