"""Operator 10: rendezvous hashing of stable record keys over weighted shards (SQL functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselight.llm.shared import documents_of, settled

#: Rows that share one numbering block, on average.
BLOCK_ROWS = 100_000


def shard_of(key: Column, weights: list[float], seed: int = 0) -> Column:
    """The shard whose score ``weight / -ln(u)`` is highest, u in (0, 1) being a hash of key and shard.

    A shard's score depends on the key and that shard alone: adding a shard moves rows only into it,
    raising a weight moves rows only into that shard. A null key counts as a key of its own. Scores
    that tie go to the higher shard number.
    """
    if not weights or min(weights) < 0 or not max(weights):
        raise ValueError("weights must not be negative, and one must be positive")
    kept = [(i, w) for i, w in enumerate(weights) if w > 0]

    def score(i: int, weight: float) -> Column:
        # 52 bits and a half: never 0 or 1
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(i), key), 12).cast("double")
        u = (bits + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(i).alias("shard"))

    scores = [score(i, w) for i, w in kept]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return best.getField("shard")


def sharded(spark: SparkSession, df: DataFrame, key: str, weights: list[float], grown: list[float],
            carry: list[str]) -> DataFrame:
    """``carry`` columns with ``shard``, ``slot`` (gapless from 0 in the shard) and ``grown_shard``.

    Slots need no task per shard: rows are dealt to blocks of about ``BLOCK_ROWS`` by a hash that also
    takes the row's place in the input, blocks are counted (summed map-side), and a row's slot is its
    rank in its block plus the rows of the blocks before. Equal keys, null keys and repeated rows
    spread over all blocks of their shard. The rows are written first, so a lost executor cannot
    change a rank between the two reads.
    """
    rows = df.select(*carry, shard_of(F.col(key), weights).alias("shard"),
                     shard_of(F.col(key), grown).alias("grown_shard"),
                     F.monotonically_increasing_id().alias("_place"))
    rows = settled(spark, rows, "shards")
    blocks = rows.count() // BLOCK_ROWS + 8
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_place"), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n")).select(
        "shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("shard", "_block").orderBy("_place")
    return rows.withColumn("_rank", F.row_number().over(within) - 1).join(counts, ["shard", "_block"]).select(
        *carry, "shard", (F.col("_before") + F.col("_rank")).cast("long").alias("slot"), "grown_shard")


def op10_rendezvous_shards(spark: SparkSession, sf_dir: str, shards: int = 16) -> DataFrame:
    """All documents in equally weighted shards by doc_id (law ``key``).

    Null texts count as no bytes; null doc_ids share one shard; an empty table gives no rows; repeated
    rows get slots of their own; extra columns are ignored.
    """
    docs = documents_of(spark, sf_dir).select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"))
    return sharded(spark, docs, "doc_id", [1.0] * shards, [1.0] * (shards + 1),
                   ["doc_id", "size", "text_crc32", "law"])
