"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor
kept, and returns documents again (the last one returns packed pieces).  A
stage's result is written as Parquet and read back as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelark.llm import decontaminate, jaccard, lines, packing, quality
from tidelark.llm.frames import discard, keep, table, temporary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _of_kept(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of docs that are in ``kept`` by doc_id and text; both sides are shuffled, as either can be of any size."""
    kept = keep(kept.select("doc_id", "row")).hint("merge")
    return docs.withColumn("row", F.xxhash64("text")).join(kept, ["doc_id", "row"], "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return _of_kept(docs, quality.quality(docs).where("kept")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; every document stays."""
    return lines.without_recurring_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least doc_id; of equal rows one stays."""
    first = jaccard.near_duplicates(docs).where("doc_id = class_id and row = class_row")
    return _of_kept(docs, first).dropDuplicates(["doc_id", "row"]).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return _of_kept(docs, decontaminate.benchmark_hits(docs, table(spark, sf_dir, "benchmark")).where("n_hit = 0")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents that are left, packed into sequences."""
    return packing.pack(docs, with_ids=False)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("decontamination", decontamination), ("best_fit_packing", best_fit_packing)]

#: Tokens and near copies have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces.  What a stage kept for itself, and its input, go from the shared folder once its result is written."""
    docs, written = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        with temporary(spark):
            docs = keep(stage(spark, docs, sf_dir), of=written)
        for path in written[:-1]:
            discard(spark, path)
        del written[:-1]
    return STAGES[-1][1](spark, docs, sf_dir)
