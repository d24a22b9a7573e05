"""Registered queries of the subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybird.llm.conversation_trie import prefix_trie, rebuilt, turn_order
from tallybird.llm.decontaminate import find_items
from tallybird.llm.filter_audit import audit_filters
from tallybird.llm.html_text import extract_text
from tallybird.llm.kneser_ney import fit_model, score_texts
from tallybird.llm.license_scan import scan_licenses
from tallybird.llm.mixing import mix_sources
from tallybird.llm.ngram_join import near_duplicates
from tallybird.llm.quality import ACCEPT, fit_quality, score_quality
from tallybird.llm.secret_ledger import BASE_RULES, count_of, listed, scan_versions
from tallybird.llm.texts import remainder
from tallybird.llm.token_planes import read_ids, write_ids
from tallybird.llm.topk import exact_top_k
from tallybird.llm.toxicity import score_toxicity


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "class_id", "n_links")


def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    texts = extract_text(table(spark, folder, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_licenses(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.transform("licenses", lambda x: x["template_id"]), ",").alias("licenses"),
    )


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = F.col("findings")
    base = tuple(rule.kind for rule in BASE_RULES)
    return scan_versions(table(spark, folder, "documents").select("doc_id", "text")).select(
        F.col("row.doc_id").alias("doc_id"),
        *[count_of(found, kind).alias(f"n_{kind}") for kind in base],
        F.sha2(listed(found, base), 256).alias("base_sha256"),
        listed(found).alias("spans"),
    )


def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = fit_quality(docs, labels, remainder(labels["doc_id"], 4) != 2)
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
    )


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return score_toxicity(docs, labels, remainder(labels["doc_id"], 5) != 0).select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op7_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = find_items(docs, table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        (F.size("item_ids") > 0).alias("contaminated"),
        F.size("item_ids").cast("long").alias("n_items"),
        "item_ids",
    )


def op9_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix_sources(table(spark, folder, "documents"))
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


def op8_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return exact_top_k(table(spark, folder, "embeddings"))


def op10_language_model_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    scored = score_texts(docs, fit_model(docs.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    files = write_ids(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read_ids(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(rebuilt(turn_order(table(spark, folder, "conversations"))))


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit_filters(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_html_extraction,
        op3_license_scan,
        op4_secret_scan,
        op5_quality_classifier,
        op6_toxicity,
        op7_benchmark_decontamination,
        op8_exact_top_k,
        op9_source_mixing,
        op10_language_model_scores,
        op11_token_ids,
        op12_conversation_trie,
        op13_filter_audit,
    )
}
