"""The corpus pipeline: the stages of STAGES one after the other, each written and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accountlens.llm import decontaminate, langid, packing, pii, simhash
from accountlens.llm.common import fresh, staged, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a language (no text, no letter) go."""
    pred, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    marked = langid.classify(docs, langid.profiles(docs), "text", pred, score)
    return marked.where(F.col(pred) != langid.UNDETERMINED).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group the document with the smallest doc_id stays.

    Rows that repeat a doc_id are one document. Rows without an id stay if no row with one is in their group.
    """
    groups = simhash.near_duplicates(docs, shingle=4, distance=4)
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leak_id")).distinct()
    return docs.join(found, docs["doc_id"] == found["leak_id"], "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: each identifier gives way to its kind; n_chars keeps to the new text."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else masked


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: where each piece of each document goes, with the checksum of its ids."""
    return packing.place(staged(packing.pieces(docs, digest=True), "pieces"))


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("PII", personal_data),
    ("best-fit packing", packed),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = staged(docs, f"stage-{at + 1}")
    return docs
