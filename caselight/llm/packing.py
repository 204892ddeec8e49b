"""Operator 2: packing by non-negative least squares over shallow length combinations."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselight.llm.shared import documents_of, settled, small_side
from caselight.llm.word_ids import WordIds

WINDOW = 4096
END_ID = 2
#: A piece's length class is its length over this, rounded down; combinations are of classes.
UNIT = 64
#: Pieces of a combination, at most.
DEPTH = 4
#: Pieces that share a block of the residual stream, on average.
BLOCK_ROWS = 50_000
#: Characters whose ids are held at once in a Python worker.
TOGETHER = 2_500_000

_PIECE = ("piece long, part int, nth long, class int, doc_id {kind}, start long, length long, ids_crc32 long, "
          "doc_tokens long, ids binary")


def pieces_of(docs: DataFrame, path: str) -> DataFrame:
    """Full windows and the rest of each document: ids of windows are only summed up, those of rests kept."""
    kind = dict(docs.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        coder = WordIds(path)
        seen = [0] * (WINDOW // UNIT + 1)
        number = 0

        def rows(keys: list, texts: list[str]) -> pa.RecordBatch:
            nonlocal number
            out: list[tuple] = []
            for key, ids in zip(keys, coder.of(texts)):
                whole = np.empty(len(ids) + 1, "<u4")
                whole[:-1] = ids
                whole[-1] = END_ID
                for start in range(0, len(whole), WINDOW):
                    piece = whole[start : start + WINDOW]
                    c = len(piece) // UNIT
                    raw = piece.tobytes()
                    out.append(((part << 36) + number, part, seen[c], c, key, start, len(piece), zlib.crc32(raw),
                                len(whole), None if len(piece) == WINDOW else raw))
                    seen[c] += 1
                    number += 1
            names = ["piece", "part", "nth", "class", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), key_type, *[pa.int64()] * 4, pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(names), kinds)], names)

        for batch in batches:
            key_type = batch.schema.field("doc_id").type
            keys, texts, size = [], [], 0
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                keys.append(key)
                texts.append(text or "")
                size += len(texts[-1])
                if size > TOGETHER:
                    yield rows(keys, texts)
                    keys, texts, size = [], [], 0
            yield rows(keys, texts)

    return docs.select("doc_id", "text").mapInArrow(cut, _PIECE.format(kind=kind))


# ---- the plan: combinations and how often to repeat each -------------------------------------------


def combinations(total: int, depth: int, least: int = 1) -> list[tuple[int, ...]]:
    """Ascending tuples of up to ``depth`` classes that sum to ``total``."""
    found = [(total,)] if total >= least else []
    if depth > 1:
        for first in range(least, total // 2 + 1):
            found += [(first, *rest) for rest in combinations(total - first, depth - 1, first)]
    return found


def non_negative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that makes ||a x - b|| least, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, np.abs(a.T @ b).max())
    for _ in range(3 * n):
        slope = a.T @ (b - a @ x)
        slope[passive] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= tolerance:
            break
        passive[best] = True
        while True:
            trial = np.zeros(n)
            trial[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            low = passive & (trial <= 0)
            if not low.any():
                break
            step = (x[low] / np.maximum(x[low] - trial[low], 1e-300)).min()
            x += step * (trial - x)
            passive &= x > 1e-12
            x[~passive] = 0.0
            if not passive.any():
                break
        if not passive.any():
            break
        x = trial
    return x


def repeats(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and how often to use each: the least-squares solution, rounded so that no class runs out.

    The squares are weighted by class, so that long pieces are placed first; then what rounding left over
    is filled with whole combinations again, greedily.
    """
    total = WINDOW // UNIT
    every = combinations(total, DEPTH)
    a = np.zeros((total + 1, len(every)))
    for j, combination in enumerate(every):
        for c in combination:
            a[c, j] += 1
    have = histogram.astype(np.int64).copy()
    weight = np.sqrt(np.arange(total + 1) + 1.0)
    scale = max(1.0, float(have.max()))
    x = non_negative_least_squares(a * weight[:, None], have * weight / scale) * scale
    counts = np.zeros(len(every), np.int64)
    need = a.astype(np.int64)
    for wanted in (np.floor(x + 1e-6).astype(np.int64), np.full(len(every), np.iinfo(np.int64).max)):
        for j in np.lexsort((np.arange(len(every)), -x)):
            used = need[:, j] > 0
            more = int(min(wanted[j], (have[used] // need[used, j]).min()))
            if more > 0:
                counts[j] += more
                have -= more * need[:, j]
    return [(every[j], int(counts[j])) for j in np.flatnonzero(counts)]


def slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, rank after the last, first sequence, position): what a piece's rank in its class gets."""
    made, rank, sequence = [], {}, 0
    for combination, count in plan:
        for position, c in enumerate(combination):
            first = rank.get(c, 0)
            made.append((c, first, first + count, sequence, position))
            rank[c] = first + count
        sequence += count
    return made


# ---- placing ---------------------------------------------------------------------------------------


def _sums_before(df: DataFrame, block: str, order: str, value: Column, name: str) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` over the rows before it in the order of (block, order).

    Only the totals of the blocks, one row each, are ordered in one place.
    """
    within = Window.partitionBy(block).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(F.lit(0)).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(block).agg(F.sum(value).alias("_total")).select(
        block, F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_before"))
    return df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0))).join(totals, block).withColumn(
        name, F.col("_before") + F.col("_within")).drop("_before", "_within")


def packed(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for every piece of ``docs``.

    Lengths are counted by class (65 rows to the driver); combinations of classes that sum to a window are
    repeated as the least squares say, and a piece's rank in its class gives its sequence and position. As
    classes round down, a combination fills its window, and what runs over is cut off. Cut-off ends and
    unplaced pieces make one stream that is cut every ``WINDOW`` ids, so only its last sequence has padding.
    Ranks and sums are made per task or block and shifted by the totals before; no class, however frequent,
    is in one task.
    """
    pieces = settled(spark, pieces_of(docs, path), "pieces")
    narrow = pieces.drop("ids")
    per_part = settled(spark, narrow.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n")), "classes")
    histogram = np.zeros(WINDOW // UNIT + 1, np.int64)
    for row in per_part.groupBy("class").agg(F.sum("n").alias("n")).collect():
        histogram[row["class"]] = row["n"]
    plan = repeats(histogram)
    planned = sum(n for _, n in plan)
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = settled(spark, per_part.select(
        "class", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")), "shifts")
    ranked = narrow.join(small_side(shifts), ["class", "part"]).withColumn("rank", F.col("shift") + F.col("nth"))
    # at most DEPTH rows for each combination in use, of which there are at most as many as classes and greedy fills
    table = F.broadcast(spark.createDataFrame(
        slots(plan), "slot_class int, low long, high long, base long, position int"))
    placed = ranked.join(table, (F.col("class") == F.col("slot_class")) & (F.col("rank") >= F.col("low"))
                         & (F.col("rank") < F.col("high")), "left")
    placed = placed.withColumn("sequence_id", F.col("base") + F.col("rank") - F.col("low")).select(
        "piece", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "position")
    placed = settled(spark, placed, "placed")

    in_window = Window.partitionBy("sequence_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    fitted = placed.where("sequence_id is not null").withColumn(
        "offset", F.least(F.coalesce(F.sum("length").over(in_window), F.lit(0)), F.lit(WINDOW)))
    fitted = settled(spark, fitted.withColumn("taken", F.least("length", F.lit(WINDOW) - F.col("offset"))), "fitted")

    rest = placed.where("sequence_id is null").select("piece", "start", "length", "doc_id", "ids_crc32", "doc_tokens",
                                                      F.lit(0).cast("long").alias("skipped")).unionAll(
        fitted.where("taken < length").select(
            "piece", "start", F.col("length"), "doc_id", "ids_crc32", "doc_tokens", F.col("taken").alias("skipped")))
    rest = settled(spark, rest, "rest")
    blocks = rest.count() // BLOCK_ROWS + 8
    rest = rest.withColumn("block", F.pmod(F.xxhash64("piece"), F.lit(blocks)))
    stream = _sums_before(rest, "block", "piece", F.col("length") - F.col("skipped"), "at")
    first, last = F.floor(F.col("at") / WINDOW), F.floor((F.col("at") + F.col("length") - F.col("skipped") - 1) / WINDOW)
    stream = stream.withColumn("window", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("at"), F.col("window") * WINDOW)
    high = F.least(F.col("at") + F.col("length") - F.col("skipped"), (F.col("window") + 1) * WINDOW)
    stream = stream.select(
        "piece", "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.lit(planned) + F.col("window")).alias("sequence_id"), (low - F.col("window") * WINDOW).alias("offset"),
        (F.col("skipped") + low - F.col("at")).alias("inside"), (high - low).alias("taken"))
    columns = stream.columns
    every = settled(spark, fitted.where("taken > 0").withColumn("inside", F.lit(0).cast("long")).select(
        columns).unionAll(stream), "placements")

    out = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    whole = every.where("taken = length").select(*out)
    cuts = every.where("taken < length").select("piece", "inside", "taken", "sequence_id", "offset")
    kind = dict(docs.dtypes)["doc_id"]

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [zlib.crc32(memoryview(ids)[4 * inside : 4 * (inside + taken)]) for ids, inside, taken in zip(
                batch.column("ids").to_pylist(), batch.column("inside").to_pylist(), batch.column("taken").to_pylist())]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "start": batch.column("from"), "length": batch.column("taken"),
                "ids_crc32": pa.array(sums, pa.int64()), "doc_tokens": batch.column("doc_tokens"),
                "sequence_id": batch.column("sequence_id"), "offset": batch.column("offset")})

    parts = pieces.select("piece", "doc_id", "start", "doc_tokens", "ids").where("ids is not null").join(
        small_side(settled(spark, cuts, "cuts")), "piece").select(
        "doc_id", (F.col("start") + F.col("inside")).alias("from"), "taken", "inside", "doc_tokens", "sequence_id",
        "offset", "ids").mapInArrow(
        sum_up, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return whole.unionAll(parts)


def op2_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents in sequences of at most 4096 ids, by the tokenizer at ``tokenizer``.

    Null and empty texts are one end id; repeated rows and null doc_ids are packed like others; an empty table
    gives no rows; other columns are ignored. Pieces of full windows and combinations leave no padding; the
    last sequence of the residual stream may.
    """
    import public_tokenizers

    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    return packed(spark, documents_of(spark, sf_dir).select("doc_id", "text"), path)
