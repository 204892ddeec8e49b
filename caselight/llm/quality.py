"""Operator 8: quality rules by a length-normalised log-likelihood ratio of hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.llm.shared import Words, documents_of, settled, small_batches, small_side

#: Buckets of the two multinomials: a fixed size, whatever the corpus.
BUCKETS = 1 << 16
#: Bytes of a gram.
GRAM = 4
#: Share of the trusted documents (those labelled good) that the threshold rejects.
REJECT_TRUSTED = 0.002

_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
_WINDOW = 5
_FOLD = np.uint32(2654435761)


def gram_buckets(text: str | None) -> np.ndarray:
    """The bucket of each byte gram of ``text``; a shorter text is one gram; none without text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if not len(raw):
        return np.empty(0, np.int64)
    k = min(GRAM, len(raw))
    codes = np.zeros(len(raw) - k + 1, np.uint32)
    for i in range(k):
        codes = (codes << np.uint32(8)) | raw[i : len(raw) - k + 1 + i]
    return ((codes * _FOLD) >> np.uint32(16)).astype(np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(bucket, raw, trusted): grams of all ``text``, and of those with ``trusted`` set. A task gives one
    row per bucket, so what is shuffled does not depend on the length of the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in small_batches(batches):
            for text, trusted in zip(*(batch.column(c).to_pylist() for c in ("text", "trusted"))):
                grams = gram_buckets(text)
                np.add.at(sums[0], grams, 1)
                if trusted:
                    np.add.at(sums[1], grams, 1)
        some = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_pydict({"bucket": some, "raw": sums[0][some], "trusted": sums[1][some]})

    made = docs.select("text", "trusted").mapInArrow(count, "bucket long, raw long, trusted long")
    return made.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log p(trusted) - log p(raw) per bucket, both smoothed by one. At most ``BUCKETS`` rows are collected."""
    raw, trusted = np.ones(BUCKETS), np.ones(BUCKETS)
    found = counts.toPandas()
    raw[found["bucket"]] += found["raw"]
    trusted[found["bucket"]] += found["trusted"]
    return (np.log(trusted / trusted.sum()) - np.log(raw / raw.sum())).round(9)


def repeat_words(text: str | None) -> int:
    """Words in 5-word windows that occur twice or more in the text."""
    words = Words(text, fold=False)
    if words.n <= _WINDOW:
        return 0
    _, window, times = np.unique(words.runs(_WINDOW), return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[window] > 1)
    edges = np.zeros(words.n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + _WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


def duplicate_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in (text or "").split("\n") if line.strip(_SPACES)]
    return len(lines) - len(set(lines))


def mean_ratios(texts: list[str], ratios: np.ndarray) -> list[float]:
    """Mean log ratio of each text's grams (0 if none); grams, eight bytes a byte, are held for one text at a time."""
    means = []
    for text in texts:
        grams = gram_buckets(text)
        means.append(float(ratios[grams].mean()) if len(grams) else 0.0)
    return means


def described(docs: DataFrame, ratios: np.ndarray, columns: list[str]) -> DataFrame:
    """``columns`` with the base counts of ``text`` and ``score``, the mean log ratio of its grams (0 if none)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # BUCKETS doubles

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            made = {c: batch.column(c) for c in columns}
            made["n_words"] = [len(t.encode("utf-8", "surrogatepass").split()) for t in texts]
            made["word_chars"] = [len(t) - sum(map(t.count, _SPACES)) for t in texts]
            made["n_symbols"] = [sum(map(t.count, _SYMBOLS)) for t in texts]
            made["n_dup_lines"] = [duplicate_lines(t) for t in texts]
            made["n_repeat_words"] = [repeat_words(t) for t in texts]
            made["score"] = mean_ratios(texts, shared.value)
            yield pa.RecordBatch.from_pydict(made)

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "n_words long, word_chars long, n_symbols long",
                        "n_dup_lines long, n_repeat_words long, score double"])
    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(describe, schema)


def verdicts(spark: SparkSession, docs: DataFrame, labels: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` columns (``doc_id`` among them) with base counts, ``score``, ``base_failed`` and ``kept``.

    Every document takes part in the raw counts and gets a verdict. The threshold is the exact
    ``REJECT_TRUSTED`` quantile of the trusted documents' scores (rounded to 4 places, which bounds its
    size); without trusted documents only the base rules decide.
    """
    good = settled(spark, labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct(), "trusted")
    good = small_side(good.withColumn("trusted", F.lit(True)), 1_000_000)
    joined = docs.join(good, "doc_id", "left")
    ratios = log_ratios(gram_counts(joined))
    scored = settled(spark, described(joined, ratios, [*carry, "trusted"]), "quality")
    least = scored.where("trusted").agg(F.percentile(F.round("score", 4), REJECT_TRUSTED)).first()[0]
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    passes = F.lit(True) if least is None else F.round("score", 4) >= F.lit(least)
    return scored.drop("trusted").withColumn("base_failed", failed).withColumn("kept", ~failed & passes)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document.

    Null text counts as none and fails the base rules; null doc_ids are never trusted; repeated rows each
    get a verdict; equal texts get equal scores; an empty table gives no rows; other columns are ignored.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return verdicts(spark, documents_of(spark, sf_dir).select("doc_id", "text"), labels, ["doc_id"])
