"""Operators 11 to 13 against plain versions and SQL."""

from __future__ import annotations

import random
import tracemalloc
import zlib
from hashlib import sha256

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caselight.llm import neighbours, prefix_trie, queries, source_audit
from tests.llm import brute
from tests.llm.conftest import SMALL
from tests.llm.tables import LONG, PASSAGE, prose, write


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


def by_sql(folder, table, sql):
    tables = duckdb.connect()
    tables.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return in_order(tables.execute(sql).fetchall())


# ---- 11

def vectors(n, seed=3, d=16):
    """Vectors around a few centres, with lengths that differ."""
    r = np.random.default_rng(seed)
    centres = r.standard_normal((8, d))
    x = centres[r.integers(0, 8, n)] + 0.4 * r.standard_normal((n, d))
    return (x * r.uniform(0.5, 1.5, (n, 1))).astype(np.float32)


def exact(rows, every, k):
    """Plain search over (vec_id, embedding) rows."""
    rows = [(i, v) for i, v in rows if v is not None and len(v) == 16 and any(v) and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([v for _, v in rows], np.float64)
    out = []
    for a, (i, _) in enumerate(rows):
        if i is not None and i % every == 0:
            score = (x * x[a]).sum(axis=1)
            order = sorted((b for b in range(len(rows)) if b != a),
                           key=lambda b: (-score[b], rows[b][0] is None, rows[b][0] or 0))[:k]
            out += [(i, n + 1, rows[b][0], float(score[b])) for n, b in enumerate(order)]
    return out


def odd_vectors():
    x = vectors(60).tolist()
    rows = [(i, v) for i, v in enumerate(x)]
    rows += [(100, None), (101, []), (102, [0.0] * 16), (103, [float("nan"), *x[0][1:]]), (104, [None, *x[0][1:]]),
             (120, [float("inf"), *x[0][1:]]), (140, [1.0] * 3), (None, x[5]), (None, x[7]), (20, x[3]), (20, x[3]), (7, x[7])]
    return rows + [(200 + i, x[9]) for i in range(50)]


def test_search_on_odd_rows(spark, tmp_path):
    folder = write(tmp_path, [], embeddings=odd_vectors())
    found = queries.QUERIES["op11_learned_partitions"](spark, folder).collect()
    wanted = exact(odd_vectors(), 20, 20)
    assert in_order((q, r, round(s, 9)) for q, r, _, s in found) == in_order((q, r, round(s, 9)) for q, r, _, s in wanted)
    assert in_order(tuple(r)[:3] for r in found) == in_order(r[:3] for r in wanted)


@pytest.mark.parametrize("cells,runs", [(1 << 22, 16_384), (500, 7)])
def test_search_recall_and_order(spark, tmp_path, monkeypatch, cells, runs):
    """Learned parts, several blocks and runs, a third of the rows one vector."""
    monkeypatch.setattr(neighbours, "QUERY_ROWS", runs)
    x = vectors(4000)
    x[::3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    folder = write(tmp_path, [], embeddings=rows)
    df = spark.read.parquet(f"{folder}/embeddings.parquet").repartition(5)
    found = neighbours.search(spark, df, F.col("vec_id") % 20 == 0, 20).collect()
    by = {}
    for q, rank, i, score in found:
        assert score == pytest.approx(float((x[q].astype(float) * x[i].astype(float)).sum()), abs=1e-12)
        by.setdefault(q, []).append((rank, i, score))
    wanted = {}
    for q, _, i, _ in exact(rows, 20, 20):
        wanted.setdefault(q, []).append(i)
    assert set(by) == set(wanted)
    for q, got in by.items():
        got.sort()
        assert [r for r, _, _ in got] == list(range(1, 21))
        assert sorted(got, key=lambda r: (-r[2], r[1])) == got
    assert np.mean([len({i for _, i, _ in by[q]} & set(wanted[q])) / 20 for q in by]) >= 0.9
    assert [i for _, i, _ in by[0]] == wanted[0]  # copies of the query: the least ids


def test_parts_are_balanced_and_follow_the_graph():
    x = vectors(1024).astype(float)
    edges = neighbours.nearest(x, x, 16, np.arange(1024))
    label = neighbours.balanced_parts(edges, 3, np.random.default_rng(0))
    assert np.bincount(label).tolist() == [128] * 8
    assert (label[edges] == label[:, None]).mean() > 0.5  # 0.125 by chance


def test_a_small_router_tries_few_parts():
    router = neighbours.fitted(vectors(4000).astype(float), 3, 20)
    assert 1 <= router.tries < 8 and neighbours.fitted(vectors(40).astype(float), 3, 20) is None


# ---- 12

def odd_conversations():
    r = random.Random(5)
    first = [("user", "hello"), ("assistant", "hi"), ("user", "é𝒜 and more"), ("assistant", ""), ("user", "five"), ("assistant", "six")]
    rows = []
    for c in [*range(0, 40), 100, 101, 150, 199, 205, 1000, 1099, -5, -100, -7]:
        n = r.randint(1, 9)
        for t in range(n):
            role, text = first[t % 6] if r.random() < 0.8 else ("user", f"own {r.randint(0, 3)}")
            rows.append((c, t, role, text))
    rows += [(300, None, "user", "null first"), (300, 0, None, None), (300, 1, "", ""), (300, 1, "", ""), (None, 0, "user", "nobody"),
             (301, 0, "user", LONG), (302, 0, "user", LONG), (303, 5, "user1", "23"), (304, 5, "user", "123")]
    rows += [(500 + c, t, *first[t]) for c in range(60) for t in range(3)]
    rows += [(700, t, "user", f"turn {t % 3}") for t in range(400)] + [(799, t, "user", f"turn {t % 3}") for t in range(390)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("shards", [None, 1, 7, 60])
def test_trie(spark, tmp_path, monkeypatch, shards):
    monkeypatch.setattr(prefix_trie, "ENDS_ROWS", 4)
    folder = write(tmp_path, [], conversations=odd_conversations())
    if shards is None:
        found = queries.QUERIES["op12_prefix_trie"](spark, folder)
    else:
        turns = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
        cut = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6)).cast("int")
        found = prefix_trie.trie(spark, prefix_trie.rebuilt(turns, cut, F.col("conv_id") - F.col("conv_id") % 100), shards)
    assert found.columns == prefix_trie.COLUMNS
    assert in_order(found.collect()) == in_order(brute.trie(odd_conversations()))


def test_trie_equals_sql(spark, tmp_path):
    folder = write(tmp_path, [], conversations=odd_conversations())
    for at in (folder, SMALL):
        found = queries.QUERIES["op12_prefix_trie"](spark, at)
        assert in_order(found.collect()) == by_sql(at, "conversations", prefix_trie.prefix_trie_sql())


def test_a_hot_conversation_is_split(spark):
    """Equal paths fill several shards, and their ids are hashed in order."""
    rows = [(i, 0, "user", "same") for i in range(0, 30_000, 100)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    paths = prefix_trie.rebuilt(turns, F.lit(0), F.col("conv_id")).cache()
    skeleton = prefix_trie.skeleton_of(paths, 8)
    assert len({skeleton.shard(r["path"], r["conv_id"]) for r in paths.collect()}) > 4
    root, leaf = sorted(prefix_trie.trie(spark, paths, 8).collect(), key=lambda r: r["depth"])
    assert root["n_convs"] == leaf["n_convs"] == 300 and root["saved_tokens"] == leaf["saved_tokens"] == 299 * 4
    assert leaf["ends_sha256"] == sha256(",".join(str(r[0]) for r in rows).encode()).hexdigest()
    assert root["ends_sha256"] == prefix_trie.EMPTY_SHA256


# ---- 13

def odd_sources():
    r = random.Random(9)
    words = [*(f"{a}{b}" for a in "abcdefgh" for b in "xyz"), "É", "éa", "日本", "Don", "UP"]
    docs, sources = [], []
    for i in range(400):
        docs.append((i, r.choice(["  ", ", ", "1", "\n"]).join(r.choice(words[: 4 + i % 25]) for _ in range(r.randint(0, 30)))))
        sources.append((r.choice(["en", "en", "de", None]), r.choice(["a", "b", "é", None, "c"])))
    docs += [(400, None), (401, ""), (402, LONG), (403, PASSAGE), (None, prose(3, 40)), (404, "x y")]
    sources += [("fr", "only"), ("en", "empty"), ("en", "a"), ("de", ""), (None, None), ("fr", "other")]
    return docs, sources


@pytest.mark.parametrize("cells,left,held", [(1 << 20, 256, 300_000), (8, 2, 10)])
def test_audit(spark, tmp_path, monkeypatch, cells, left, held):
    for name, value in (("CELLS", cells), ("LEFT", left), ("HELD_TERMS", held)):
        monkeypatch.setattr(source_audit, name, value)
    docs, sources = odd_sources()
    folder = write(tmp_path, docs, sources=sources)
    found = queries.QUERIES["op13_source_audit"](spark, folder)
    wanted = brute.audit([(t, a, b) for (_, t), (a, b) in zip(docs, sources, strict=True)])
    assert in_order(found.select("lang", "source", "part", "item", "value", "rank").collect()) == in_order(wanted)
    assert in_order(wanted) == by_sql(folder, "documents", source_audit.source_audit_sql())


def test_audit_of_given_documents(spark):
    found = queries.QUERIES["op13_source_audit"](spark, SMALL)
    assert in_order(found.select("lang", "source", "part", "item", "value", "rank").collect()) == \
        by_sql(SMALL, "documents", source_audit.source_audit_sql())


def test_shares_are_exact_beyond_long_products(spark):
    df = spark.createDataFrame([(10**12 + 7, 3 * 10**13 + 1, 10**6)], "n long, total long, terms long")
    p = df.select(source_audit._share("n", "total", "terms")).first()[0]
    assert p == 1 + 10**9 * (10**12 + 12) // (3 * 10**13 + 1 + 5 * 10**6)


def test_cut_uses_the_unsigned_checksum(spark):
    got = spark.range(50).select("id", F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(6))).collect()
    assert [r[1] for r in got] == [zlib.crc32(str(r[0]).encode()) % 6 for r in got]


def test_the_fit_holds_few_scores_at_once():
    x = np.random.default_rng(3).standard_normal((2048, 8))
    tracemalloc.start()
    found = neighbours.nearest(x, x, 16, np.arange(len(x)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20  # all scores are 32 MB, and there were three such arrays
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    assert all(set(a) == set(b) for a, b in zip(found, np.argsort(-score, axis=1)[:, :16], strict=True))


def test_the_sample_comes_by_code_and_then_by_components():
    rows = [([2.0, 1.0], 7), ([1.0, 9.0], 7), ([5.0, 0.0], -3), ([1.0, 2.0], 7)]
    table = pa.table({"vector": [r[0] for r in rows], "code": [r[1] for r in rows]})
    assert neighbours.in_order(table).tolist() == [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))]
