"""What a Python worker holds at once."""

from __future__ import annotations

import weakref

import numpy as np
import pyarrow as pa

from caselight.llm import ngram_join, quality, shared, token_counts


def test_grams_of_one_text_are_held_at_a_time(monkeypatch):
    usual, made, most = quality.gram_buckets, [], []

    def tracked(text):
        grams = usual(text)
        made.append(weakref.ref(grams))
        most.append(sum(r() is not None for r in made))
        return grams

    ratios = np.arange(quality.BUCKETS, dtype=float)
    texts = ["some words", "", "other words", "abc"] * 5
    plain = [float(ratios[usual(t)].mean()) if t else 0.0 for t in texts]
    monkeypatch.setattr(quality, "gram_buckets", tracked)
    assert quality.mean_ratios(texts, ratios) == plain
    assert max(most) <= 2


def test_few_texts_are_split_together():
    texts = ["word " * 20_000] * 40  # four million characters
    found = token_counts.spans(texts)
    assert [i for a, b in found for i in range(a, b)] == list(range(40))
    assert max(sum(len(t) for t in texts[a:b]) for a, b in found) <= 1_100_000
    assert token_counts.spans([]) == [(0, 0)]


def test_workers_take_the_rows_of_a_batch_a_few_at_a_time():
    batch = pa.RecordBatch.from_pydict({"x": list(range(2 * shared.SMALL_BATCH + 7))})
    found = list(shared.small_batches(iter([batch, batch.slice(0, 0), batch.slice(3, 2)])))
    assert [b.num_rows for b in found] == [shared.SMALL_BATCH, shared.SMALL_BATCH, 7, 2]
    assert [x for b in found for x in b.column("x").to_pylist()] == [*range(batch.num_rows), 3, 4]


def test_no_more_texts_are_described_together(spark, monkeypatch):
    """A batch of Spark's holds up to 10,000 rows; a worker describes no more than a small batch's rows at once."""
    rows = {"doc_id": list(range(3000)), "text": [f"some words of {i}" for i in range(3000)]}
    docs = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, work, schema: work)
    describe = quality.described(docs, np.zeros(quality.BUCKETS), ["doc_id", "text"])
    found = list(describe(iter([pa.RecordBatch.from_pydict(rows)])))
    assert max(b.num_rows for b in found) <= shared.SMALL_BATCH
    assert [x for b in found for x in b.column("doc_id").to_pylist()] == rows["doc_id"]
