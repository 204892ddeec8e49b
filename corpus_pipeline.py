"""A pipeline over ``documents``: each stage works on all that the stage before it kept.

Rows with nulls pass through every stage by the rules of its operator, rows without doc_id too; repeated rows count as
copies, of which the class keeps one; an empty table stays empty; columns beyond those of ``documents`` are dropped at the start.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.llm import decontamination, ngram_join, packing, quality, secrets
from caselight.llm.shared import documents_of, settled, small_side

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the likelihood ratio keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.verdicts(spark, docs.select(COLUMNS), labels, COLUMNS).where("kept").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: one of the doc_id that names the class.

    Of several texts of that doc_id in the class the one with the least hash stays, of repeated rows one. A class
    without any doc_id keeps one row too. Documents without words stand alone and all stay.
    """
    found = settled(spark, ngram_join.classes(spark, docs.select("doc_id", "text")), "classes").where("set_key is not null")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    chosen = settled(spark, found.groupBy("class_key").agg(F.min(row).alias("chosen"), F.count(F.lit(1)).alias("_n")).where("_n > 1"),
                     "chosen")
    in_class = found.join(small_side(chosen), "class_key")
    others = ~(F.col("doc_id").eqNullSafe(F.col("chosen.doc_id")) & (F.col("text_hash") == F.col("chosen.text_hash")))
    gone = in_class.where(others).select(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.xxhash64("text") == F.col("_text_hash"))
    kept = docs.select(COLUMNS).join(small_side(settled(spark, gone, "gone")), same, "left_anti")
    repeated = found.groupBy(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash")).agg(
        F.count(F.lit(1)).alias("_n")).where("_n > 1")
    repeated = settled(spark, repeated.drop("_n"), "repeated")
    if repeated.isEmpty():
        return kept
    again = small_side(repeated)
    once = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, same, "left_anti").unionByName(once)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whole or edited."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("long"), "text")
    digest = F.sha2("text", 256)  # a doc_id may name several texts
    found = decontamination.contaminated(docs.select(digest.alias("digest"), "text"), benchmark, "digest")
    gone = settled(spark, found.select(F.col("digest").alias("_gone")).distinct(), "leaks")
    return docs.select(COLUMNS).join(small_side(gone), digest == F.col("_gone"), "left_anti")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; ``n_chars`` of changed texts counted anew."""
    found = secrets.with_spans(spark, docs.select(COLUMNS))
    changed = F.size("_spans") > 0
    text = F.when(changed, secrets.redacted(F.col("text"), F.col("_spans"))).otherwise(F.col("text"))
    # two steps: a higher-order function used twice in one select is evaluated wrongly the second time
    masked = found.select("doc_id", text.alias("text"), "lang", "source", "n_chars", changed.alias("_changed"))
    return masked.withColumn(
        "n_chars", F.when(F.col("_changed"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop("_changed")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 ids."""
    import public_tokenizers

    return packing.packed(spark, docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("packing", packed_sequences),
]

#: Hashes, alignment and packing are not expressible in SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = documents_of(spark, sf_dir)
    for name, stage in STAGES:
        docs = settled(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
