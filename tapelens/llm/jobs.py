"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelens.llm import (
    checks, decontaminate, html_model, language_codes, minmax_dedup, packing, perspectives, pii, prefix_trie,
    quality_rules, secret_links, size_aware_join, spans, structure_repair, suffix_dedup)
from tapelens.llm.base import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return register


@query("op1_quality_rules", checks.QUALITY_RULES)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"))
    bits = F.col("failure_bits")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality_rules.rejected(bits, quality_rules.POLICIES["base"]).alias("base_failed"),
        (~quality_rules.rejected(bits, quality_rules.POLICIES[quality_rules.CURRENT])).alias("kept"),
        "failure_bits", "n_lines")


@query("quality_ablations", checks.QUALITY_ABLATIONS)
def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents")))


@query("op6_minmax_dedup", checks.MINMAX_DEDUP)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4)


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), packing.default_tokenizer()))


@query("op3_decontamination", checks.DECONTAMINATION)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("id_", "hash_")


@query("op7_pii")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[spans.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS],
        F.sha2(spans.written(F.col("base")), 256).alias("base_sha256"),
        F.coalesce(spans.written(F.col("found")), F.lit("")).alias("spans"),
        F.coalesce(F.aggregate(F.transform("found", lambda s: s["score"]), F.lit(0.0), lambda a, b: F.greatest(a, b)),
                   F.lit(0.0)).alias("top_score"))


@query("op4_secret_links")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_links.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[spans.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in secret_links.BASE_KINDS],
        F.sha2(spans.written(F.col("base")), 256).alias("base_sha256"),
        spans.written(F.col("found")).alias("spans"))


@query("op2_perspectives", checks.PERSPECTIVES)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


@query("op9_language_codes")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_codes.identify(table(spark, sf_dir, "documents"))


@query("op8_html_model")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_model.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query("op11_structure_repair", checks.STRUCTURE_REPAIR)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return structure_repair.repair_digests(structure_repair.damaged(turns), turns)


@query("op12_size_aware_join", checks.SIZE_AWARE_JOIN)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return size_aware_join.similar_documents(table(spark, sf_dir, "documents"))


@query("op13_prefix_trie", checks.PREFIX_TRIE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.shared_prefixes(table(spark, sf_dir, "conversations"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
