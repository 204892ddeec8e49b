"""Operator 7: benchmark decontamination by n-gram seeds and Smith-Waterman alignment."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.llm.shared import Words, documents_of

#: Words of a seed.
SEED_WORDS = 3
#: Benchmark text that one pass over the documents takes: more items make more passes, not larger tasks.
BLOCK_BYTES = 16_000_000
#: Word scores of the alignment; a pair's score is its best local alignment over that of a full match.
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.6
#: Alignments are made over a stretch of the document this much longer than the item, on each side of its seeds.
SLACK_WORDS = 8

_OTHER_PUNCTUATION = regex.compile(r"[\p{P}\p{S}]+")
_PUNCTUATION = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def normal_words(text: str | None) -> Words:
    """Words lower-cased, punctuation and symbols read as spaces."""
    text = (text or "").lower()
    if not text.isascii():
        text = _OTHER_PUNCTUATION.sub(" ", text)
    return Words(text, fold=False, table=_PUNCTUATION)


@dataclass
class Item:
    item_id: int | None
    words: list[bytes]


@dataclass
class Seeds:
    """Sorted distinct seeds of some items; item k holds seeds ``of[k]`` (positions in ``hashes``)."""

    items: list[Item]
    hashes: np.ndarray
    of: list[np.ndarray]

    def owners(self) -> tuple[np.ndarray, dict[int, list[int]]]:
        by_seed: dict[int, list[int]] = defaultdict(list)
        for k, mine in enumerate(self.of):
            for s in mine:
                by_seed[int(self.hashes[s])].append(k)
        return np.array(sorted(by_seed), np.uint64), dict(by_seed)


def seeds_of(rows: list[tuple[int | None, str | None]]) -> Seeds:
    items, runs = [], []
    for item_id, text in rows:
        words = normal_words(text)
        if words.n >= SEED_WORDS:
            items.append(Item(item_id, words.words))
            runs.append(np.unique(words.runs(SEED_WORDS)))
    hashes = np.unique(np.concatenate(runs)) if runs else np.empty(0, np.uint64)
    return Seeds(items, hashes, [np.searchsorted(hashes, r) for r in runs])


def item_blocks(benchmark: DataFrame) -> Iterator[Seeds]:
    """The benchmark in blocks of about ``BLOCK_BYTES``, dealt by a hash of the text."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    for b in range(blocks):
        mine = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield seeds_of(sorted(((r["item_id"], r["text"]) for r in mine.collect()), key=repr))


def _places(sorted_hashes: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``runs`` of those that are in ``sorted_hashes``, and where they are there."""
    if not len(sorted_hashes) or not len(runs):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(sorted_hashes, runs), len(sorted_hashes) - 1)
    hit = np.flatnonzero(sorted_hashes[at] == runs)
    return hit, at[hit]


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word-id sequences (linear gaps), and its end in ``b``."""
    ramp = -GAP * np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, np.int64)
    best, end = 0, 0
    for word in a:
        step = np.maximum(row + GAP, 0)
        np.maximum(step[1:], row[:-1] + np.where(b == word, MATCH, MISMATCH), out=step[1:])
        row = np.maximum.accumulate(step + ramp) - ramp
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def local_match(item: list[bytes], stretch: list[bytes]) -> tuple[float, int, int]:
    """Score from 0 to 1 and the aligned words [start, end) of ``stretch``."""
    ids: dict[bytes, int] = {}
    a, b = (np.array([ids.setdefault(w, len(ids)) for w in words], np.int64) for words in (item, stretch))
    best, end = aligned(a, b)
    back = aligned(a[::-1], b[:end][::-1])[1]
    return best / (MATCH * len(item)), end - back, end


def stretches(item: list[bytes], words: list[bytes], low: int, high: int) -> list[tuple[float, int, int]]:
    """(score, start, end) of the item's matches in words [low, high), the best first, then what lies beside it."""
    found = []
    todo = [(low, high)]
    while todo:
        low, high = todo.pop()
        held = set(words[low:high])
        # a score is no more than the share of the item's words that the stretch holds
        if sum(w in held for w in item) / len(item) < LEAST_SCORE:
            continue
        score, start, end = local_match(item, words[low:high])
        if score >= LEAST_SCORE:
            found.append((round(score, 6), low + start, low + end))
            todo += [(low, low + start), (low + end, high)]
    return found


def apart(found: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """Of stretches that overlap, the best one; of equal ones the first."""
    kept: list[tuple[float, int, int]] = []
    for score, start, end in sorted(set(found), key=lambda m: (-m[0], m[1], m[2])):
        if all(end <= a or b <= start for _, a, b in kept):
            kept.append((score, start, end))
    return kept


def matches(words: Words, seeds: Seeds, known: np.ndarray, owners: dict[int, list[int]]) -> list[tuple]:
    """(item_id, score, start, end) of the items that a document holds, for each stretch that holds one."""
    runs = words.runs(SEED_WORDS)
    hits, at = _places(known, runs)
    by_item: dict[int, list[int]] = defaultdict(list)
    for position, seed in zip(hits.tolist(), at.tolist()):
        for k in owners[int(known[seed])]:
            by_item[k].append(position)
    found = []
    for k, positions in by_item.items():
        item = seeds.items[k]
        reach = len(item.words) + SLACK_WORDS
        here: list[tuple[float, int, int]] = []
        first = last = positions[0]
        for position in [*positions[1:], None]:
            if position is not None and position - first <= reach:
                last = position
                continue
            here += stretches(item.words, words.words, max(0, first - reach), min(words.n, last + reach + SEED_WORDS))
            if position is not None:
                first = last = position
        found += [(item.item_id, *m) for m in apart(here)]
    return sorted(found, key=repr)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, item_id, score, start_word, end_word): items that a document holds, whole or edited.

    Seeds are all word trigrams of an item: which of them an edited copy keeps is not known, and frequencies
    don't tell (exact copies make all others look rare). A common phrase starts no alignment where the words around
    it rule the item out. Each pass over the
    documents takes a block of the benchmark of bounded size, which is broadcast; nothing of the
    documents but the matches is shuffled or collected.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, item_id long, score double, start_word long, end_word long"
    parts = []
    for seeds in item_blocks(benchmark):
        if not seeds.items:
            continue
        known, owners = seeds.owners()
        shared = spark.sparkContext.broadcast((seeds, known, owners))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, rows = [], []
                for k, text in zip(batch.column(key).to_pylist(), batch.column("text").to_pylist()):
                    found = matches(normal_words(text), *shared.value)
                    keys += [k] * len(found)
                    rows += found
                columns = list(zip(*rows)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, batch.schema.field(key).type), pa.array(columns[0], pa.int64()),
                     pa.array(columns[1], pa.float64()), *(pa.array(c, pa.int64()) for c in columns[2:])],
                    [key, "item_id", "score", "start_word", "end_word"])

        parts.append(docs.select(key, "text").mapInArrow(search, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    made = parts[0]
    for part in parts[1:]:
        made = made.unionAll(part)
    return made


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document holds; documents without one give no row.

    An item that a document holds several times gives a row for each. Null and empty texts hold none; items of
    fewer than three words (or null) match nothing; items with equal texts each match; repeated rows each give their rows; null doc_ids stay; empty tables give no
    rows; other columns are ignored.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("long"), "text")
    return contaminated(documents_of(spark, sf_dir).select("doc_id", "text"), benchmark)
