"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, extract, jaccard, languages, lines, negatives, oracle, packing, personal, quality, secrets, sharding, substrings, turns
from .frames import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.cut_spans(substrings.repeated_spans(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("row", "lang", "source")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def _span_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, kinds), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(secrets.secrets(table(spark, sf_dir, "documents")), ("assign", "access", "hex"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(personal.personal_data(table(spark, sf_dir, "documents")), personal.KINDS)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).drop("row", "class_row")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, with their markup and addresses, and documents, whose source is the host and whose lang is the declaration.

    The text model is trained on a sample of the same documents and their
    lang, so for documents the declaration isn't independent of the text's evidence.
    """
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    none = F.lit(None)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), none.cast("long").alias("page_id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit(False).alias("is_page"))
    html = F.col("html")
    rows = rows.unionByName(pages.select(none.cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), html.alias("text"), languages.declared_of(html).alias("declared"), extract.host_of(F.col("url")).alias("host"), F.lit(True).alias("is_page")))
    found = languages.identify(rows, languages.train(docs), keys=["doc_id", "page_id"], is_page="is_page")
    return found.withColumn("probability", F.round("probability", 6))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.without_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return turns.repair(turns.damaged(rows), rows.select("conv_id"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)


QUERIES = {"op1_substring_dedup": op1_substring_dedup, "op2_language_id": op2_language_id, "op3_secret_scans": op3_secret_scans, "op4_line_dedup": op4_line_dedup, "op5_quality_rules": op5_quality_rules, "op6_ngram_jaccard": op6_ngram_jaccard, "op7_personal_data": op7_personal_data, "op8_best_fit_packing": op8_best_fit_packing, "op9_html_extraction": op9_html_extraction, "op10_decontamination": op10_decontamination, "op11_conversation_repair": op11_conversation_repair, "op12_sharding": op12_sharding, "op13_hard_negatives": op13_hard_negatives}
ORACLE_SQL = {"op1_substring_dedup": oracle.OP1, "op6_ngram_jaccard": oracle.OP6, "op10_decontamination": oracle.OP10, "op11_conversation_repair": oracle.OP11, "op12_sharding": oracle.OP12, "op13_hard_negatives": oracle.OP13}
