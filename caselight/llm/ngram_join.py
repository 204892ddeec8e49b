"""Operator 1: n-gram Jaccard join over token-combination prefixes.

A document is its set of distinct shingles of five words, as 64-bit hashes. Two sets link when
100 * |intersection| >= 75 * |union|; then the larger lacks at most a quarter of its shingles in the other.

Shingles fall in classes: rare ones, and frequent ones dealt to several classes by their hash. In the order
(rare before frequent, then hash) a set's prefix is extended until

    rare shingles + sum over frequent classes of (shingles - 1) > a quarter of the set.

Of two linked sets, take the prefix that ends first: its shingles that the other set holds lie in the other's
prefix too, and more of them are shared than missing, so one rare shingle or two of one frequent class are
shared. Single rare shingles and pairs within a frequent class are therefore a complete index.

The number of frequent classes depends on the size of a set only through its power of two; a set whose
partners may lie in the next band is indexed for both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.llm.components import components
from caselight.llm.shared import Words, documents_of, list_array, mixed, settled, small_batches, small_side

SHINGLE_WORDS = 5
#: A shingle in the prefixes of more sets than this is frequent.
RARE = 64
#: Frequent shingles that tasks may hold as one sorted array (8 bytes each); beyond it they are joined.
HELD_SHINGLES = 2_000_000
#: Buckets of more members than this are compared in blocks of about this many.
BLOCK = 64
#: Rounds in which each bucket is linked through one member, before what is left is paired.
STAR_ROUNDS = 2


def may_link(n: Column, m: Column) -> Column:
    return (4 * F.least(n, m)) >= (3 * F.greatest(n, m))


def missing_at_most(n: int) -> int:
    """Shingles of a set of n that a linked set may lack."""
    return n // 4


def prefix_length(n: int) -> int:
    """Smallest hashes that are kept at first: enough if at most the last sixteenth of the set among them is frequent."""
    return min(n, missing_at_most(n) + 1 + n // 16)


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(Words(text).runs(SHINGLE_WORDS))


def set_key(shingles: np.ndarray) -> int:
    """64 bits of a digest of the whole set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def bands(n: int) -> list[int]:
    own = n.bit_length() - 1
    return [own, own + 1] if 4 * n >= 3 * (2 << own) else [own]


def signatures(shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Index entries of a sorted set; ``frequent`` marks its frequent shingles."""
    n = len(shingles)
    need = missing_at_most(n) + 1
    rare = shingles[~frequent]
    if len(rare) >= need:
        return rare[:need]
    parts = [rare]
    common = shingles[frequent]
    for band in bands(n):
        classes = np.uint64(max(1, (1 << band) // 32))
        kind = mixed(common ^ np.uint64(band + 1)) % classes
        # a class's first shingle adds nothing, each further one adds one
        first = np.zeros(len(common), bool)
        first[np.unique(kind, return_index=True)[1]] = True
        enough = np.cumsum(~first) + len(rare) >= need
        end = int(enough.argmax()) + 1 if enough.any() else len(common)
        order = np.argsort(kind[:end], kind="stable")
        sorted_kind, sorted_common = kind[:end][order], common[:end][order]
        borders = np.flatnonzero(np.diff(sorted_kind)) + 1
        for members in np.split(sorted_common, borders):
            i, j = np.triu_indices(len(members), 1)
            parts.append(mixed(mixed(members[i]) + members[j] + np.uint64(band)))
    return np.unique(np.concatenate(parts))


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64)


#: What ``classes`` needs of a row besides its set: its own doc_id, which may be null, and a hash of its text.
CARRIED = ("named", "text_hash")


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, place, set_key, n_shingles, last, prefix) of every row, and ``CARRIED`` columns that ``docs`` has; no words:
    null key, empty prefix.

    ``last`` is the largest hash of the prefix, as a signed number of the same order; ``place`` names the row.
    """
    kinds = dict(docs.dtypes)
    carried = [c for c in CARRIED if c in kinds]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 36
        for batch in small_batches(batches):
            keys, sizes, lasts, prefixes = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingle_set(text)
                prefix = found[: prefix_length(len(found))]
                keys.append(set_key(found) if len(found) else None)
                sizes.append(len(found))
                lasts.append(int(prefix[-1]) - (1 << 63) if len(prefix) else None)
                prefixes.append(_signed(prefix))
            places = np.arange(place, place + len(keys))
            place += len(keys)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(places, pa.int64()), pa.array(keys, pa.int64()),
                 pa.array(sizes, pa.int64()), pa.array(lasts, pa.int64()), list_array(prefixes),
                 *(batch.column(c) for c in carried)],
                ["doc_id", "place", "set_key", "n_shingles", "last", "prefix", *carried])

    more = "".join(f", {c} {kinds[c]}" for c in carried)
    return docs.select("doc_id", "text", *carried).mapInArrow(
        describe, f"doc_id {kinds['doc_id']}, place long, set_key long, n_shingles long, last long, prefix array<long>{more}")


def _full_sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(set_key, n, shingles) for the chosen (set_key, rep) rows, read from the texts again."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            for key, text in zip(batch.column("set_key").to_pylist(), batch.column("text").to_pylist()):
                found = shingle_set(text)
                if set_key(found) == key:  # a doc_id may name several texts
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key], pa.int64()), pa.array([len(found)], pa.int64()), list_array([_signed(found)])],
                        ["set_key", "n", "shingles"])

    texts = docs.join(chosen, docs["doc_id"] == chosen["rep"]).select("set_key", "text")
    return texts.mapInArrow(build, "set_key long, n long, shingles array<long>").dropDuplicates(["set_key"])


def index_of(spark: SparkSession, docs: DataFrame, sets: DataFrame, rare: int = RARE,
             held: int = HELD_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """(sig, set_key, n, central), the entries; and (set_key, n, last, f, shared) of the sets indexed by rare
    shingles alone.

    ``sets``: (set_key, rep, n, last, prefix), distinct. ``shared`` are the prefix's rare shingles that another
    set's prefix holds, ``f`` counts its frequent ones. A linked set holds all of the prefix but a quarter of n,
    so sets that share less with all others together are left out.
    """
    entries = sets.select("set_key", F.explode("prefix").alias("sig"))
    counts = settled(spark, entries.groupBy("sig").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shingle-counts")
    frequent = counts.where(F.col("df") > rare).select("sig")
    many = frequent.count()
    single = counts.where(F.col("df") <= rare).select("sig")
    with_frequent = more = None
    if many:
        if many <= held:
            sorted_frequent = np.sort(frequent.toPandas()["sig"].to_numpy(np.int64).view(np.uint64))
            shared = spark.sparkContext.broadcast(sorted_frequent)

            def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    found = [int(_among(np.array(p, np.int64).view(np.uint64), shared.value).sum())
                             for p in batch.column("prefix").to_pylist()]
                    made = pa.RecordBatch.from_arrays(
                        [*(batch.column(c) for c in ("set_key", "rep", "n")), pa.array(found, pa.int64())],
                        ["set_key", "rep", "n", "f"])
                    yield made.filter(pa.array([f > 0 for f in found], pa.bool_()))

            kind = dict(sets.dtypes)["rep"]
            with_frequent = sets.select("set_key", "rep", "n", "prefix").mapInArrow(
                count, f"set_key long, rep {kind}, n long, f long")
        else:
            f = entries.join(frequent, "sig").groupBy("set_key").agg(F.count(F.lit(1)).alias("f"))
            with_frequent = sets.select("set_key", "rep", "n").join(f, "set_key")
        # sets whose kept prefix holds too few rare shingles are indexed anew from their whole texts
        dense = _prefix_length(F.col("n")) - F.col("f") <= F.floor(F.col("n") / 4)
        with_frequent = settled(spark, with_frequent.withColumn("dense", dense), "frequent-sets")
        whole = _full_sets(docs, small_side(with_frequent.where("dense").select("set_key", "rep")))
        if many <= held:
            def entries_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    found = [np.array(s, np.int64).view(np.uint64) for s in batch.column("shingles").to_pylist()]
                    marks = [_among(s, shared.value) for s in found]
                    made = [_signed(signatures(s, m)) for s, m in zip(found, marks)]
                    yield _entry_batch(batch.column("set_key"), batch.column("n"), marks, made)

            more = whole.mapInArrow(entries_of, _ENTRIES)
        else:
            flagged = whole.select("set_key", "n", F.explode("shingles").alias("sig")).join(
                frequent.withColumn("_f", F.lit(True)), "sig", "left").groupBy("set_key", "n").agg(
                F.collect_list(F.struct("sig", F.coalesce("_f", F.lit(False)).alias("f"))).alias("all"))

            def entries_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    marks, made = [], []
                    for rows in batch.column("all").to_pylist():
                        sigs = np.array([r["sig"] for r in rows], np.int64).view(np.uint64)
                        order = np.argsort(sigs)
                        marks.append(np.array([r["f"] for r in rows], bool)[order])
                        made.append(_signed(signatures(sigs[order], marks[-1])))
                    yield _entry_batch(batch.column("set_key"), batch.column("n"), marks, made)

            more = flagged.mapInArrow(entries_of, _ENTRIES)
        more = settled(spark, more, "dense-entries").select("set_key", "n", "central", F.explode("sigs").alias("sig"))
        single = single.union(more.select("sig")).distinct()
    lists = entries.join(single, "sig").groupBy("set_key").agg(F.collect_list("sig").alias("shared"))
    lists = lists.join(sets.select("set_key", "n", "last"), "set_key")
    if with_frequent is None:
        lists = lists.withColumn("f", F.lit(0).cast("long"))
    else:
        lists = lists.join(small_side(with_frequent.select("set_key", "f", "dense")), "set_key", "left").where(
            "dense is null or not dense").withColumn("f", F.coalesce("f", F.lit(0))).drop("dense")
    lists = settled(spark, lists.where(
        F.size("shared") + F.col("f") >= _prefix_length(F.col("n")) - F.floor(F.col("n") / 4)), "shared-prefixes")
    central = (F.size("shared") + F.col("f")) / _prefix_length(F.col("n"))
    index = lists.select(F.explode("shared").alias("sig"), "set_key", "n", central.alias("central"))
    return (index if more is None else index.unionAll(more.select("sig", "set_key", "n", "central"))), lists


def _prefix_length(n: Column) -> Column:
    return F.least(n, F.floor(n / 4) + 1 + F.floor(n / 16))


def possible(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` that their prefixes do not rule out.

    Say a's prefix ends first. All shingles that b shares with it lie in b's prefix as well, so the sets share no
    more than the prefixes do, the frequent ones of either, and what a has after its prefix. A set without a list
    (indexed from its whole text) rules out nothing.
    """
    side = lambda x: lists.select(*(F.col(c).alias(f"{c}_{x}") for c in ("set_key", "n", "last", "f", "shared")))
    both = pairs.join(side("a").withColumnRenamed("set_key_a", "a"), "a", "left").join(
        side("b").withColumnRenamed("set_key_b", "b"), "b", "left")
    c = F.col
    n = F.when(c("last_a") <= c("last_b"), c("n_a")).otherwise(c("n_b"))
    most = F.size(F.array_intersect("shared_a", "shared_b")) + F.least("f_a", "f_b") + n - _prefix_length(n)
    enough = 7 * most >= 3 * (c("n_a") + c("n_b"))
    return both.where(c("n_a").isNull() | c("n_b").isNull() | enough).select("a", "b")


def _among(shingles: np.ndarray, sorted_frequent: np.ndarray) -> np.ndarray:
    if not len(shingles):
        return np.zeros(0, bool)
    at = np.minimum(np.searchsorted(sorted_frequent, shingles), len(sorted_frequent) - 1)
    return sorted_frequent[at] == shingles


_ENTRIES = "set_key long, n long, central double, sigs array<long>"


def _entry_batch(keys: pa.Array, sizes: pa.Array, marks: list[np.ndarray], made: list[np.ndarray]) -> pa.RecordBatch:
    central = pa.array([float(m.mean()) for m in marks], pa.float64())
    return pa.RecordBatch.from_arrays([keys, sizes, central, list_array(made)], ["set_key", "n", "central", "sigs"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets link. ``texts``: (set_key, text)."""
    one = texts.select(F.col("set_key").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("set_key").alias("b"), F.col("text").alias("text_b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for batch in small_batches(batches):
            keep = []
            for a, t, u in zip(*(batch.column(c).to_pylist() for c in ("a", "text_a", "text_b"))):
                if a != last[0]:
                    last = (a, shingle_set(t))
                other = shingle_set(u)
                both = len(np.intersect1d(last[1], other, assume_unique=True))
                keep.append(100 * both >= 75 * (len(last[1]) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def linked(spark: SparkSession, docs: DataFrame, names: DataFrame, index: DataFrame, lists: DataFrame) -> DataFrame:
    """(node, label) of sets that link with another: the components of all links.

    A bucket of m sets is first linked through its most central member, m - 1 pairs; only buckets that still hold several
    components go on, with another member. At last small buckets make their pairs across components, and the sets
    of large ones are compared in blocks.
    Pairs within a component need no check, so a group of near copies costs its size, not its square.
    """
    edges: DataFrame | None = None
    tested: DataFrame | None = None
    labels: DataFrame | None = None
    left = index
    for turn in range(STAR_ROUNDS + 1):
        if turn:
            named = index.withColumn("label", F.col("set_key")) if labels is None else index.join(
                labels.withColumnRenamed("node", "set_key"), "set_key", "left")
            named = named.select("sig", "set_key", "n", "central", F.coalesce("label", "set_key").alias("label"))
            several = named.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"),
                                               F.count(F.lit(1)).alias("size")).where("lo <> hi")
            left = settled(spark, named.join(several.select("sig", "size"), "sig"), f"left-{turn}")
        if turn < STAR_ROUNDS:
            # first the most central member, to which all edited copies link, then any of eight
            rank = F.xxhash64("set_key", F.col("sig") % 8) if turn else -F.col("central")
            hub = F.min(F.struct(rank.alias("rank"), "set_key", "n", *(["label"] if turn else []))).alias("hub")
            pairs = left.join(left.groupBy("sig").agg(hub), "sig").where(
                (F.col("hub.set_key") != F.col("set_key")) & may_link(F.col("n"), F.col("hub.n")))
            if turn:
                pairs = pairs.where(F.col("label") != F.col("hub.label"))
            one, two = F.col("set_key"), F.col("hub.set_key")
            pairs = pairs.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))
        else:
            pairs = _across(left.where(F.col("size") <= BLOCK))
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = settled(spark, possible(pairs, lists), f"pairs-{turn}")
        large = left.where(F.col("size") > BLOCK) if turn == STAR_ROUNDS else None
        if large is not None and large.isEmpty():
            large = None
        if pairs.isEmpty() and large is None:
            continue
        tested = pairs if tested is None else tested.unionAll(pairs)
        wanted = pairs.select(F.col("a").alias("set_key")).union(pairs.select("b"))
        if large is not None:
            wanted = wanted.union(large.select("set_key"))
        wanted = small_side(settled(spark, wanted.distinct().join(names, "set_key"), f"wanted-{turn}"))
        texts = settled(spark, _right_texts(docs.join(wanted, docs["doc_id"] == wanted["rep"]).select(
            "set_key", "text")), f"texts-{turn}")
        found = verified(pairs, texts)
        if large is not None:
            found = found.unionAll(linked_in_blocks(spark, large, texts))
        found = settled(spark, found, f"links-{turn}")
        edges = found if edges is None else edges.unionAll(found)
        labels = components(spark, edges, f"sets-{turn}")
    if labels is None:
        return spark.createDataFrame([], "node long, label long")
    return labels


def _right_texts(texts: DataFrame) -> DataFrame:
    """Of the rows (set_key, text), one for each key, those whose text has that key."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            keep = [set_key(shingle_set(t)) == k for k, t in zip(
                batch.column("set_key").to_pylist(), batch.column("text").to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return texts.mapInArrow(check, "set_key long, text string").dropDuplicates(["set_key"])


def _across(left: DataFrame) -> DataFrame:
    """Pairs of different components in buckets of at most ``BLOCK`` members."""
    one, two = left.alias("one"), left.alias("two")
    c = F.col
    return one.join(two, (c("one.sig") == c("two.sig")) & (c("one.set_key") < c("two.set_key"))
                    & (c("one.label") != c("two.label")) & may_link(c("one.n"), c("two.n"))).select(
        c("one.set_key").alias("a"), c("two.set_key").alias("b"))


def linked_in_blocks(spark: SparkSession, large: DataFrame, texts: DataFrame) -> DataFrame:
    """Links across components among sets that meet in large buckets, each two sets compared once.

    Near copies that do not link share hundreds of buckets. Sets that any large bucket joins form a group; its
    sets are dealt to blocks of about ``BLOCK``, and each two blocks meet in one task, as texts, where overlaps are
    counted together. A group of g sets makes g * g / BLOCK rows, no pairs.
    """
    hubs = large.groupBy("sig").agg(F.min("set_key").alias("hub"))
    groups = components(spark, large.join(hubs, "sig").select(F.col("set_key").alias("a"), F.col("hub").alias("b")), "groups")
    members = settled(spark, large.select("set_key", "label").distinct().join(
        groups.select(F.col("node").alias("set_key"), F.col("label").alias("group")), "set_key"), "members")
    sizes = settled(spark, members.groupBy("group").agg(
        (F.count(F.lit(1)) / BLOCK + 1).cast("int").alias("blocks")), "group-sizes")
    dealt = members.join(small_side(sizes), "group").withColumn("own", F.pmod(F.xxhash64("set_key"), "blocks").cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "group", "set_key", "label", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def check(table: pa.Table) -> pa.Table:
        keys = table["set_key"].to_numpy()
        labels, own = table["label"].to_numpy(), table["own"].to_numpy()
        sets = [shingle_set(t) for t in table["text"].to_pylist()]
        sizes = np.array([len(x) for x in sets], np.int64)
        values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rows = np.repeat(np.arange(len(sets)), sizes)
        shared = times[at] > 1
        rows, columns = rows[shared], (np.cumsum(times > 1) - 1)[at[shared]]
        both = np.zeros((len(sets), len(sets)), np.float64)
        order = np.argsort(columns, kind="stable")
        rows, columns = rows[order], columns[order]
        step = 8192
        for first in range(0, int(columns[-1]) + 1 if len(columns) else 0, step):
            a, b = np.searchsorted(columns, [first, first + step])
            held = np.zeros((len(sets), step), np.float32)
            held[rows[a:b], columns[a:b] - first] = 1
            both += held @ held.T
        link = 100 * both >= 75 * (sizes[:, None] + sizes[None, :] - both)
        link &= (labels[:, None] != labels[None, :]) & (keys[:, None] < keys[None, :])
        if table["x"][0].as_py() != table["y"][0].as_py():
            link &= own[:, None] != own[None, :]
        i, j = np.nonzero(link)
        return pa.table({"a": pa.array(keys[i], pa.int64()), "b": pa.array(keys[j], pa.int64())})

    return met.join(texts, "set_key").groupBy("group", "x", "y").applyInArrow(check, "a long, b long")


def classes(spark: SparkSession, docs: DataFrame, rare: int = RARE, held: int = HELD_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_key, text_hash, class_key) for every row of ``docs`` (doc_id, text).

    Equal sets are one node from the start; their rows are summed map-side, so copies cost nothing later. Rows without
    doc_id link others like any row; a hash of their text stands for the id where texts are looked up.
    """
    kind = dict(docs.dtypes)["doc_id"]
    text_hash = F.xxhash64("text")
    docs = docs.select(F.coalesce(F.col("doc_id"), text_hash.cast(kind)).alias("doc_id"), "text",
                       F.col("doc_id").alias("named"), text_hash.alias("text_hash"))
    rows = settled(spark, described(docs), "sets")
    docs = docs.select("doc_id", "text")
    names = rows.where("set_key is not null").groupBy("set_key").agg(
        F.min(F.struct("doc_id", "place")).alias("first"), F.min("named").alias("least"))
    names = settled(spark, names.select("set_key", F.col("first.doc_id").alias("rep"), F.col("first.place").alias("place"), "least"),
                    "distinct-sets")
    sets = rows.join(small_side(names.select("place", "rep")), "place").select(
        "set_key", "rep", F.col("n_shingles").alias("n"), "last", "prefix")
    index, lists = index_of(spark, docs, sets, rare, held)
    labels = linked(spark, docs, names.select("set_key", "rep"), index, lists)
    joined = names.join(labels.withColumnRenamed("node", "set_key"), "set_key", "left").select(
        "set_key", "least", F.coalesce("label", "set_key").alias("label"))
    joined = settled(spark, joined, "labelled")
    least = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    named = settled(spark, joined.join(least, "label").select(
        "set_key", "component_id", F.col("label").alias("class_key")), "components")
    return rows.select(F.col("named").alias("doc_id"), "n_shingles", "set_key", "text_hash").join(named, "set_key", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "set_key", "text_hash", "class_key")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document under links of five-word shingle sets.

    Null and empty texts have no shingles and stand alone; texts of fewer than five words are one shingle;
    rows without doc_id link others too and get the class's smallest doc_id, null if it has none; repeated rows each give
    a row; an empty table gives no rows; other columns are ignored.
    """
    docs = documents_of(spark, sf_dir).select("doc_id", "text")
    return classes(spark, docs).drop("set_key", "text_hash", "class_key")
