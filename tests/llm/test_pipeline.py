"""The pipeline's stages on odd rows and on the smallest given tables."""

from __future__ import annotations

import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import SMALL
from tests.llm.tables import LONG, odd_documents, prose, write

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage(spark, folder, name):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    made = dict(corpus_pipeline.STAGES)[name](spark, docs, folder)
    if name != "packing":
        assert made.columns == COLUMNS
    return made.collect()


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "packing"]


def test_duplicates_leave_one_of_each_class(spark, odd):
    """Null and repeated ids included: a class is told by its smallest doc_id, one without by a text of its own."""
    kept = [(r["doc_id"], r["text"]) for r in stage(spark, odd, "ngram_jaccard_join")]
    docs = odd_documents()
    assert sorted(kept, key=repr) == sorted(set(kept), key=repr) and set(kept) <= set(docs)
    component = {(d, t): c for (d, t), c in zip(sorted(docs, key=repr), _components(sorted(docs, key=repr)))}
    told = lambda rows: sorted((repr(component[r]) for r in rows if brute.shingles(r[1])))
    assert told(kept) == sorted(map(repr, set(component[r] for r in docs if brute.shingles(r[1]))))
    for doc_id, text in kept:
        least = component[doc_id, text]
        assert not brute.shingles(text) or least[0] is None or least[0] == doc_id
    assert [r for r in kept if not brute.shingles(r[1])] and (None, prose(6, 80)) in kept
    assert sum(t == docs[5][1] for _, t in kept) == 1  # the copy without doc_id goes


def _components(docs):
    """(smallest doc_id or None, smallest text) of the class of each row, by plain search."""
    sets = [brute.shingles(t) for _, t in docs]
    label = list(range(len(docs)))
    for _ in docs:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    members = {k: [d for d, n in zip(docs, label) if n == k] for k in label}
    return [(min((d for d, _ in members[k] if d is not None), default=None), min(t or "" for _, t in members[k])) for k in label]


def test_a_text_without_id_links_others(spark, tmp_path):
    words = prose(9, 60).split()
    texts = [" ".join([*words[:k], *(f"other{k}x{i}" for i in range(2)), *words[k + 2 :]]) for k in (10, 30, 50)]
    mixed = " ".join([*words[:30], "other30x0", "other30x1", *words[32:]])
    docs = [(1, " ".join(words)), (None, mixed), (3, mixed + " " + prose(10, 12)), (None, texts[0]), (None, texts[0])]
    folder = write(tmp_path, docs)
    assert [r["doc_id"] for r in stage(spark, folder, "ngram_jaccard_join")] == [1]
    alone = write(tmp_path / "alone" if (tmp_path / "alone").mkdir() is None else tmp_path, docs[3:])
    assert [r["doc_id"] for r in stage(spark, alone, "ngram_jaccard_join")] == [None]


def test_decontamination_drops_what_holds_an_item(spark, odd):
    kept = stage(spark, odd, "benchmark_decontamination")
    gone = {t for _, t in odd_documents()} - {r["text"] for r in kept}
    assert gone == {prose(7, 60)}


def test_secrets_are_masked_and_nothing_else_changes(spark, odd):
    kept = {r["doc_id"]: r for r in stage(spark, odd, "secret_scans")}
    docs = dict(odd_documents())
    changed = {i for i in docs if kept[i]["text"] != docs[i] and i not in (None, 17)}
    assert changed == {14} and "abcdefgh12345678" not in kept[14]["text"]
    assert kept[14]["n_chars"] == len(kept[14]["text"])


def test_clean_documents_pass_the_first_stages(spark, tmp_path):
    docs = [(i, prose(i, 100)) for i in range(40)] + [(50, LONG), (60, "#$% " * 200)]
    folder = write(tmp_path, docs, labels=[(i, 1, 0) for i in range(40)])
    kept = {r["doc_id"] for r in stage(spark, folder, "quality_rules")}
    assert len(kept & set(range(40))) >= 39 and 60 not in kept


def test_runs(spark, empty):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    assert corpus_pipeline.run(spark, empty).count() == 0
