"""Operator 11: nearest neighbours by learned partitions of a neighbour graph.

A bounded sample gives a graph of nearest neighbours, which is cut into parts of equal size. A small classifier learns in
which parts a vector's neighbours lie. It files every row under its likeliest part and sends every query to the likeliest
few, whose rows are compared in full. How many parts a query tries comes from the recall on sample rows held out of the fit.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselight.llm.shared import settled, small_side

#: Distinct vectors that the partitions are learned from, at most about; half of them only measure recall.
SAMPLE = 16_384

#: Recall on held-out rows that decides how many parts a query tries.
RECALL = 0.95

#: Queries of that measurement.
TRIALS = 512

EDGES, HIDDEN, EPOCHS, BATCH = 16, 128, 15, 256

#: Levels of halving at most: 1024 parts.
MOST_LEVELS = 10

#: Rows of one block, and queries that meet a block in one task.
BLOCK_ROWS, QUERY_ROWS = 65_536, 16_384

#: Scores computed at once by a task, and by the driver, which holds the sample besides.
CELLS, FIT_CELLS = 1 << 22, 1 << 19

ROUTED = "place long, vec_id long, vector array<double>, part int"
FOUND = "query long, rank_id long, named boolean, score double"


# ---- learning -----------------------------------------------------------------------------------

def nearest(x: np.ndarray, to: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Rows of ``to`` with the ``k`` largest inner products for each row of ``x``; never row ``own[i]``."""
    out, step = [], max(1, FIT_CELLS // max(1, len(to)))
    for a in range(0, len(x), step):
        score = x[a : a + step] @ to.T
        if own is not None:
            score[np.arange(len(score)), own[a : a + step]] = -np.inf
        out.append(np.argpartition(np.negative(score, out=score), k - 1, axis=1)[:, :k].copy())  # not a view of all columns
    return np.concatenate(out)


def halves(nodes: np.ndarray, edges: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Two equal halves of ``nodes`` with few edges between them: by the median of a slow mode of the graph's random
    walk, then by exchanging the nodes that gain most."""
    n = len(nodes)
    place = np.full(len(edges), -1)
    place[nodes] = np.arange(n)
    a, b = np.repeat(np.arange(n), edges.shape[1]), place[edges[nodes]].ravel()
    a, b = a[b >= 0], b[b >= 0]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    degree = np.bincount(a, minlength=n) + 1.0
    mode = random.standard_normal(n)
    for _ in range(60):
        mode -= (mode * degree).sum() / degree.sum()
        mode = (mode + (np.bincount(a, weights=mode[b], minlength=n) + mode) / degree) / 2
        mode /= max(np.abs(mode).max(), 1e-300)
    side = np.zeros(n, bool)
    side[np.argsort(mode, kind="stable")[n // 2 :]] = True
    for _ in range(20):
        pull = np.bincount(a, weights=np.where(side[b], 1.0, -1.0), minlength=n)
        gain = np.where(side, -pull, pull)
        one, two = np.flatnonzero(side), np.flatnonzero(~side)
        moved = min(n // 20, int((gain[one] > 0).sum()), int((gain[two] > 0).sum()))
        if not moved:
            break
        side[one[np.argsort(-gain[one], kind="stable")[:moved]]] = False
        side[two[np.argsort(-gain[two], kind="stable")[:moved]]] = True
    return nodes[~side], nodes[side]


def balanced_parts(edges: np.ndarray, levels: int, random: np.random.Generator) -> np.ndarray:
    """The part of each node after ``levels`` halvings."""
    parts = [np.arange(len(edges))]
    for _ in range(levels):
        parts = [half for p in parts for half in halves(p, edges, random)]
    label = np.empty(len(edges), np.int64)
    for i, p in enumerate(parts):
        label[p] = i
    return label


@dataclass
class Router:
    """One hidden layer from vectors to the chances of the parts, and how many parts a query tries."""

    weights: list[np.ndarray]
    scale: float
    tries: int = 1

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x * self.scale) @ self.weights[0] + self.weights[1], 0)

    def chances(self, x: np.ndarray) -> np.ndarray:
        z = self.hidden(x) @ self.weights[2] + self.weights[3]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def likeliest(self, x: np.ndarray, k: int) -> np.ndarray:
        return np.argsort(-self.chances(x), axis=1, kind="stable")[:, :k]


def trained(x: np.ndarray, wanted: np.ndarray, random: np.random.Generator, rate: float = 3e-3) -> Router:
    """A router whose chances come near the rows of ``wanted``, by Adam on the cross entropy."""
    scale = np.sqrt(x.shape[1]) / np.sqrt((x * x).sum(axis=1)).mean()
    router = Router([random.standard_normal((x.shape[1], HIDDEN)) * np.sqrt(2 / x.shape[1]), np.zeros(HIDDEN),
                     random.standard_normal((HIDDEN, wanted.shape[1])) * np.sqrt(1 / HIDDEN), np.zeros(wanted.shape[1])], scale)
    mean, square = [np.zeros_like(w) for w in router.weights], [np.zeros_like(w) for w in router.weights]
    step = 0
    for epoch in range(EPOCHS):
        order = random.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at : at + BATCH]
            hidden = router.hidden(x[rows])
            error = (router.chances(x[rows]) - wanted[rows]) / len(rows)
            back = (error @ router.weights[2].T) * (hidden > 0)
            step += 1
            for w, g, m, s in zip(router.weights, [(x[rows] * scale).T @ back, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)],
                                  mean, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w -= rate * (1 - epoch / EPOCHS) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return router


def fitted(sample: np.ndarray, levels: int, k: int, seed: int = 7) -> Router | None:
    """A router learned from half of ``sample``; ``tries`` reaches ``RECALL`` on the other half. None: too few rows."""
    half = len(sample) // 2
    if levels < 1 or half < 4 << levels or half <= EDGES + k:
        return None
    random = np.random.default_rng(seed)
    known, rest = sample[:half], sample[half:]
    edges = nearest(known, known, EDGES, np.arange(half))
    label = balanced_parts(edges, levels, random)
    wanted = np.zeros((half, 1 << levels))
    np.add.at(wanted, (np.repeat(np.arange(half), EDGES), label[edges].ravel()), 0.5 / EDGES)
    wanted[np.arange(half), label] += 0.5
    router = trained(known, wanted, random)
    trials = rest[:TRIALS]
    true = nearest(trials, rest, min(k, len(rest) - 1), np.arange(len(trials)))
    filed = router.likeliest(rest, 1)[:, 0]
    rank = np.argsort(np.argsort(-router.chances(trials), axis=1, kind="stable"), axis=1)
    at = np.take_along_axis(rank, filed[true], axis=1).ravel()
    recall = np.cumsum(np.bincount(at, minlength=1 << levels)) / len(at)
    router.tries = int(np.searchsorted(recall, RECALL)) + 1
    return router


# ---- comparing ----------------------------------------------------------------------------------

def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    values = lists.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(lists), -1) if len(lists) else np.empty((0, 0))


def in_order(sample: pa.Table) -> np.ndarray:
    """The vectors of ``sample`` by code, ties by their components; no component becomes an object of its own."""
    x = _matrix(sample["vector"])
    return x[np.lexsort((*x.T[::-1], sample["code"].to_numpy()))] if len(x) else x


def _fewer_copies(x: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Of equal vectors the first ``k`` in ``order``: no query needs more."""
    x = np.ascontiguousarray(x[order] + 0.0)  # -0.0 equals 0.0
    _, group = np.unique(x.view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_inverse=True)
    by = np.argsort(group, kind="stable")
    first = np.concatenate([[0], np.flatnonzero(np.diff(group[by])) + 1])
    within = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
    return order[np.sort(by[within < k])]


def _compared(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The ``k`` best rows of one block for each of its queries, among the parts that the query tries."""
    out: list[tuple] = []
    if rows.num_rows and queries.num_rows:
        x, part = _matrix(rows["vector"]), rows["part"].to_numpy()
        place = rows["place"].to_numpy()
        named = rows["vec_id"].is_valid().to_numpy(zero_copy_only=False)
        ids = rows["vec_id"].fill_null(0).to_numpy()
        y, asked, tried = _matrix(queries["vector"]), queries["place"].to_numpy(), queries["part"].to_numpy()
        length = np.sqrt((x * x).sum(axis=1))
        for p in np.intersect1d(part, tried):
            here = np.flatnonzero(part == p)
            here = _fewer_copies(x, here[np.lexsort((ids[here], ~named[here]))], k + 1)
            xp, those = x[here], np.flatnonzero(tried == p)
            step = max(1, CELLS // len(here))
            for a in range(0, len(those), step):
                q = those[a : a + step]
                score = y[q] @ xp.T
                # the product's rounding depends on a row's place: what lies within its error of the best stays
                near = np.sqrt((y[q] * y[q]).sum(axis=1)) * length[here].max() * x.shape[1] * 1e-15
                least = np.partition(score, len(here) - k - 1, axis=1)[:, len(here) - k - 1] if len(here) > k + 1 else -np.inf
                i, j = np.nonzero(score >= (least - near)[:, None])
                exact = (y[q[i]] * xp[j]).sum(axis=1)
                other = asked[q[i]] != place[here[j]]
                out.append((asked[q[i]][other], ids[here[j]][other], named[here[j]][other], exact[other]))
    if not out:
        return pa.table({"query": pa.array([], pa.int64()), "rank_id": pa.array([], pa.int64()),
                         "named": pa.array([], pa.bool_()), "score": pa.array([], pa.float64())})
    query, ids, named, score = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.lexsort((ids, ~named, -score, query))
    query, ids, named, score = query[order], ids[order], named[order], score[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(query)) + 1])
    best = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query)))) < k
    return pa.table({"query": query[best], "rank_id": ids[best], "named": named[best], "score": score[best]})


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part, with a place of their own.

    Vectors that are null, empty or zero or hold null or infinite components or NaN take no part, nor do those whose
    length is not the commonest one (of equally common ones the greatest).
    """
    whole = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    return whole.where(F.col("vector").isNotNull() & finite & F.exists("vector", lambda v: v != 0.0)).withColumn(
        "place", F.monotonically_increasing_id())


def search(spark: SparkSession, vectors: DataFrame, asks, k: int, recall_rows: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows found with the largest inner products for each row where ``asks``.

    Repeated rows are candidates of each other; repeated vec_ids are queries of their own; rows without vec_id come
    last among ties; an empty table gives no rows; other columns are ignored. The number of parts grows with the square
    root of the rows, to 1024. Every row is indexed; parts of any size are cut into blocks of about ``BLOCK_ROWS``, and
    their queries into runs of about ``QUERY_ROWS``, so that a hot vector fills many tasks. Below about a hundred rows all are
    compared. The driver holds the sample and one count for each part.
    """
    rows = settled(spark, valid(vectors), "vectors")
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vector") == size["n"])
    total = size["count"]
    share = int((1 << 40) * min(1.0, recall_rows / total))
    code = F.xxhash64("vector")
    sample = rows.where(F.pmod(code, F.lit(1 << 40)) < share).groupBy("vector").agg(F.min(code).alias("code"))
    sample = in_order(sample.toArrow())
    levels = min(MOST_LEVELS, round(np.log2(max(1.0, np.sqrt(total) / 8))))
    router = fitted(sample, levels, k)

    def routed(tries: int, batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            parts = np.zeros((table.num_rows, 1), np.int64) if router is None else router.likeliest(_matrix(table["vector"]), tries)
            again = pa.array(np.repeat(np.arange(table.num_rows), parts.shape[1]))
            table = table.select(["place", "vec_id", "vector"]).take(again)
            yield from table.append_column("part", pa.array(parts.ravel().astype(np.int32))).to_batches()

    filed = settled(spark, rows.mapInArrow(partial(routed, 1), ROUTED), "filed")
    asked = settled(spark, rows.where(asks).mapInArrow(partial(routed, router.tries if router else 1), ROUTED), "asked")

    # blocks: small parts share one, large ones get several; queries meet each block of their parts in runs
    goal = max(1024, min(BLOCK_ROWS, total // 48))
    counts = {r["part"]: r["count"] for r in filed.groupBy("part").count().collect()}
    block_of, block, filled = [], 0, 0
    for p in sorted(counts):
        if filled and filled + counts[p] > goal:
            block, filled = block + 1, 0
        cuts = -(-counts[p] // (2 * goal))
        block_of.append((p, block, cuts))
        block, filled = (block + cuts, 0) if cuts > 1 else (block, filled + counts[p])
    blocks = F.broadcast(spark.createDataFrame(block_of, "part int, _first int, _cuts int"))
    filed = filed.join(blocks, "part").withColumn("block", F.col("_first") + F.pmod(F.xxhash64("place"), F.col("_cuts")).cast("int"))
    asked = asked.join(blocks, "part").withColumn("block", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_cuts") - 1)))
    met = settled(spark, asked.groupBy("block").count(), "met").select(
        "block", F.ceil(F.col("count") / QUERY_ROWS).cast("int").alias("_runs"))
    met = small_side(met)
    asked = asked.join(met, "block").withColumn("run", F.pmod(F.xxhash64("place", F.lit(1)), F.col("_runs")).cast("int"))
    filed = filed.join(met, "block").withColumn("run", F.explode(F.sequence(F.lit(0), F.col("_runs") - 1)))
    take = ["block", "run", "place", "vec_id", "vector", "part"]
    found = filed.select(take).groupBy("block", "run").cogroup(asked.select(take).groupBy("block", "run")).applyInArrow(
        lambda r, q: _compared(r, q, k), FOUND)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("named"), "rank_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    queries = rows.where(asks).select(F.col("place").alias("query"), F.col("vec_id").alias("query_id"))
    return found.join(queries, "query").select(
        "query_id", "rank", F.when(F.col("named"), F.col("rank_id")).alias("vec_id"), "score")


def op11_learned_partitions(spark: SparkSession, sf_dir: str, every: int = 20, k: int = 20) -> DataFrame:
    """The 20 nearest rows found for each row of ``embeddings`` whose vec_id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(spark, vectors, F.col("vec_id") % every == 0, k)
