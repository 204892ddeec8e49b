"""Operator 12: the trie of conversation prefixes, by a skeleton of splitter paths.

A conversation is a path of turn digests of equal length, so that a prefix of turns is a prefix of the string and
sorting brings each subtree together. Splitters taken from a sample cut the sorted order into shards; the prefixes of
the splitter paths form the skeleton, which is broadcast. Every other node lies in one shard with its whole subtree and is
finished there; skeleton nodes add up what the shards found.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.llm.shared import settled, small_side

#: Characters of one turn in a path: 128 bits in base 64, without padding.
WIDTH = 22

#: Conversations aimed at in one shard, and sampled conversations for each splitter.
SHARD_ROWS, SAMPLED = 200_000, 16
MOST_SHARDS = 20_000

#: Characters of all splitter paths together; with longer ones there are fewer shards.
SKELETON_CHARS = 8 << 20

#: Members of one skeleton node whose ids travel as one row.
ENDS_ROWS = 4096

NODES = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string, skeleton long, part int, ends string")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def turn_key(role: Column, text: Column) -> Column:
    """``WIDTH`` characters that stand for role and text; the role's length keeps the two apart."""
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.base64(F.unhex(F.md5(whole.cast("binary")))), 1, WIDTH)


def own_turns(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order: arrays of key and code points. Null turns come first, ties by key."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    one = F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn").alias("turn"),
                   turn_key(role, text).alias("key"), F.length(text).alias("chars"))
    return turns.where("conv_id is not null").select("conv_id", one.alias("one")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("one")).alias("turns"))


def rebuilt(turns: DataFrame, cut: Column, origin: Column) -> DataFrame:
    """conv_id, path and chars: the first ``cut`` turns of conversation ``origin``, then its own after its first ``cut``."""
    own = own_turns(turns)
    first = own_turns(turns.where(F.col("conv_id") == origin)).select(
        F.col("conv_id").alias("_origin"), F.col("turns").alias("_first"))
    rows = own.withColumn("_cut", cut).withColumn("_origin", origin).join(first, "_origin", "left")
    none = F.array().cast(own.schema["turns"].dataType)
    whole = F.concat(F.slice(F.coalesce("_first", none), F.lit(1), F.col("_cut")),
                     F.slice("turns", F.col("_cut") + 1, F.size("turns")))
    return rows.select("conv_id", whole.alias("turns")).select(
        "conv_id", F.array_join("turns.key", "").alias("path"), F.col("turns.chars").alias("chars"))


def _turn(path: str, depth: int) -> str:
    return path[depth * WIDTH : (depth + 1) * WIDTH]


@dataclass
class Skeleton:
    """Splitters in order, and the trie of their paths, parents before children."""

    splitters: list[tuple[str, int]]
    ids: dict[tuple[int, str], int] = field(default_factory=dict)  # by parent and turn; the root is 0
    parents: list[int] = field(default_factory=lambda: [-1])

    def __post_init__(self):
        for path, _ in self.splitters:
            node = 0
            for depth in range(len(path) // WIDTH):
                step = (node, _turn(path, depth))
                if step not in self.ids:
                    self.ids[step] = len(self.parents)
                    self.parents.append(node)
                node = self.ids[step]

    def shard(self, path: str, conv_id: int) -> int:
        return bisect_right(self.splitters, (path, conv_id))


def skeleton_of(paths: DataFrame, shards: int) -> Skeleton:
    """At most ``shards - 1`` splitters from a sample by a hash of conv_id, about ``SAMPLED`` for each shard.

    The sample holds MOST_SHARDS * SAMPLED rows at most on average; of long paths only so many are taken that their
    characters stay below ``SKELETON_CHARS``.
    """
    rows, chars = paths.agg(F.count(F.lit(1)), F.avg(F.length("path"))).first()
    if not rows or shards < 2:
        return Skeleton([])
    wanted = min(shards * SAMPLED, int(SKELETON_CHARS / max(chars, 1)) + 1)
    kept = F.pmod(F.xxhash64("conv_id"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, wanted / rows))
    sample = sorted(map(tuple, paths.where(kept).select("path", "conv_id").collect()))
    cuts, step = [], max(1.0, len(sample) / shards)
    budget = SKELETON_CHARS
    for i in range(1, shards):
        if (at := int(i * step)) >= len(sample):
            break
        budget -= len(sample[at][0])
        if budget < 0:
            break
        if not cuts or cuts[-1] != sample[at]:
            cuts.append(sample[at])
    return Skeleton(cuts)


class _Shard:
    """The nodes of one sorted shard, in the order in which they begin."""

    def __init__(self, skeleton: Skeleton):
        self.skeleton = skeleton
        self.nodes: dict[str, list] = {k: [] for k in COLUMNS}
        self.above: list[int] = []  # place of the parent in ``nodes``, or -1
        self.bone: list[int | None] = []  # skeleton node that is the parent
        self.chars: list[int] = []
        self.ends: list = []
        self.partial: dict[int, list[int]] = {}  # skeleton node: conv_id, members, children, leaves, saved, chars
        self.parts: list[tuple[int, int, str]] = []
        self.waiting: list[int] = []
        self.waiting_at = -1
        self.open: list[int] = []  # local nodes on the present path
        self.path, self.bones = "", [0]

    def add(self, path: str, conv_id: int, chars: list[int]) -> None:
        n, same = len(path) // WIDTH, 0
        while same < min(n, len(self.path) // WIDTH) and _turn(path, same) == _turn(self.path, same):
            same += 1
        before = len(self.bones)
        del self.bones[same + 1 :]
        while len(self.bones) <= n and (bone := self.skeleton.ids.get((self.bones[-1], _turn(path, len(self.bones) - 1)))):
            self.bones.append(bone)
        top = len(self.bones) - 1  # the depth of the last skeleton node on the path
        del self.open[max(same - top, 0) if len(self.bones) == before else 0 :]
        for depth in range(top + len(self.open), n):
            self._begin(depth + 1, chars[depth], conv_id)
        for place in self.open:
            self.nodes["n_convs"][place] += 1
            self.nodes["conv_id"][place] = min(conv_id, self.nodes["conv_id"][place])
        for depth, bone in enumerate(self.bones):
            got = self.partial.setdefault(bone, [conv_id, 0, 0, 0, 0, chars[depth - 1] if depth else 0])
            got[0], got[1] = min(got[0], conv_id), got[1] + 1
        if n == top:
            self._end_on_bone(self.bones[-1], conv_id)
        else:
            self.ends[self.open[-1]].append(conv_id)
        self.path = path

    def _begin(self, depth: int, chars: int, conv_id: int) -> None:
        place = len(self.above)
        parent = self.open[-1] if self.open else -1
        self.above.append(parent)
        self.bone.append(self.bones[-1] if parent < 0 else None)
        for k, v in (("conv_id", conv_id), ("depth", depth), ("n_convs", 0), ("n_children", 0), ("n_leaves", 0), ("saved_tokens", 0)):
            self.nodes[k].append(v)
        self.chars.append(chars)
        self.ends.append([])
        if parent >= 0:
            self.nodes["n_children"][parent] += 1
        else:
            self.partial.setdefault(self.bones[-1], [conv_id, 0, 0, 0, 0, 0])[2] += 1
        self.open.append(place)

    def _end_on_bone(self, bone: int, conv_id: int) -> None:
        if bone != self.waiting_at or len(self.waiting) >= ENDS_ROWS:
            self._pass_on()
        self.waiting_at = bone
        self.waiting.append(conv_id)

    def _pass_on(self) -> None:
        if self.waiting:
            self.parts.append((self.waiting_at, len(self.parts), ",".join(map(str, self.waiting))))
        self.waiting = []

    def rows(self) -> Iterator[dict[str, list]]:
        """Finished nodes; then what skeleton nodes get from here; then ids that end on them, by part."""
        self._pass_on()
        n = self.nodes
        for place in range(len(self.above) - 1, -1, -1):  # children begin after their parents
            n["saved_tokens"][place] += (n["n_convs"][place] - 1) * self.chars[place]
            n["n_leaves"][place] += not n["n_children"][place]
            if (up := self.above[place]) >= 0:
                n["saved_tokens"][up] += n["saved_tokens"][place]
                n["n_leaves"][up] += n["n_leaves"][place]
            else:
                got = self.partial[self.bone[place]]
                got[3] += n["n_leaves"][place]
                got[4] += n["saved_tokens"][place]
        n["parent_conv_id"] = [n["conv_id"][up] if up >= 0 else None for up in self.above]
        n["ends_sha256"] = [hashlib.sha256(",".join(map(str, e)).encode()).hexdigest() if e else EMPTY_SHA256 for e in self.ends]
        nothing = [None] * len(self.above)
        if self.above:
            yield n | {"skeleton": self.bone, "part": nothing, "ends": nothing}
        names = ["conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "depth"]
        if self.partial:
            blank = [None] * len(self.partial)
            got = dict(zip(names, map(list, zip(*self.partial.values(), strict=True)), strict=True))
            yield got | {"parent_conv_id": blank, "ends_sha256": blank, "skeleton": list(self.partial),
                         "part": [-1] * len(blank), "ends": blank}
        if self.parts:
            blank = [None] * len(self.parts)
            yield dict.fromkeys(COLUMNS, blank) | {"skeleton": [p[0] for p in self.parts], "part": [p[1] for p in self.parts],
                                                   "ends": [p[2] for p in self.parts]}


def _shard_nodes(skeleton: Callable[[], Skeleton]):
    """Rows sorted by shard, path and conv_id to nodes; a task holds the nodes of one shard."""
    names = [x.split()[0] for x in NODES.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in NODES.split(", ")] + [("shard", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def written(number: int, shard: _Shard) -> Iterator[pa.RecordBatch]:
            for columns in shard.rows():
                data = {k: columns[k] for k in names} | {"shard": [number] * len(columns["part"])}
                yield pa.RecordBatch.from_pydict(data, schema=schema)

        number, shard = -1, None
        for batch in batches:
            rows = zip(*(batch[c].to_pylist() for c in ("shard", "path", "conv_id", "chars")), strict=True)
            for at, path, conv_id, chars in rows:
                if at != number:
                    if shard is not None:
                        yield from written(number, shard)
                    number, shard = at, _Shard(skeleton())
                shard.add(path, conv_id, chars)
        if shard is not None:
            yield from written(number, shard)

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each skeleton node, whose parts come in order; only the state of one hash is held."""
    node, state = None, None
    out: list[tuple[int, str]] = []
    for batch in batches:
        for skeleton, ends in zip(batch["skeleton"].to_pylist(), batch["ends"].to_pylist(), strict=True):
            if skeleton != node:
                if state is not None:
                    out.append((node, state.hexdigest()))
                node, state = skeleton, hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
    if state is not None:
        out.append((node, state.hexdigest()))
    yield pa.RecordBatch.from_pydict({"skeleton": pa.array([x[0] for x in out], pa.int64()),
                                      "ends_sha256": pa.array([x[1] for x in out], pa.string())})


def trie(spark: SparkSession, paths: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per node of the trie of ``paths`` (conv_id, unique and not null; path; chars of each turn).

    A task holds one shard: about ``SHARD_ROWS`` conversations, also where many share one path, since splitters are
    pairs of path and conv_id. What the driver and broadcasts hold is the skeleton (``SKELETON_CHARS``). The ids that
    end on one skeleton node are hashed in order by one task, which reads them part by part.
    """
    paths = settled(spark, paths, "paths")
    rows = paths.count()
    if shards is None:
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        shards = min(MOST_SHARDS, max(min(least, rows // 50 + 1), rows // SHARD_ROWS))
    skeleton = skeleton_of(paths, shards)
    shared = spark.sparkContext.broadcast(skeleton)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = shared.value.shard
        for batch in batches:
            numbers = [shard(p, c) for p, c in zip(batch["path"].to_pylist(), batch["conv_id"].to_pylist(), strict=True)]
            yield batch.append_column("shard", pa.array(numbers, pa.int32()))

    dealt_rows = paths.select("conv_id", "path", "chars").mapInArrow(dealt, "conv_id long, path string, chars array<int>, shard int")
    nodes = dealt_rows.repartitionById(len(skeleton.splitters) + 1, F.col("shard")).sortWithinPartitions(
        "shard", "path", "conv_id").mapInArrow(_shard_nodes(lambda: shared.value), NODES + ", shard int")
    nodes = settled(spark, nodes, "trie-nodes")

    partial = nodes.where("part = -1").groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        F.max("depth").alias("chars"))
    ends = nodes.where("part >= 0").select("skeleton", "shard", "part", "ends").repartition("skeleton").sortWithinPartitions(
        "skeleton", "shard", "part").mapInArrow(_digests, "skeleton long, ends_sha256 string")
    bones = settled(spark, spark.createDataFrame(
        _finished(skeleton, {r["skeleton"]: r for r in partial.collect()}),
        "skeleton long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long"), "skeleton")
    whole = bones.join(ends, "skeleton", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)))
    parents = small_side(bones.select("skeleton", F.col("conv_id").alias("_above")))
    local = nodes.where("part is null").join(parents, "skeleton", "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "_above"))
    return whole.select(COLUMNS).unionByName(local.select(COLUMNS))


def _finished(skeleton: Skeleton, got: dict) -> list[tuple]:
    """The skeleton's nodes from the sums of all shards, from the ends of its paths to the root.

    ``n_convs`` and ``conv_id`` of the shards hold all members; the rest holds what hangs on the node itself.
    """
    if not got:
        return []
    n = len(skeleton.parents)
    children = [got[i]["n_children"] for i in range(n)]
    for parent in skeleton.parents[1:]:
        children[parent] += 1
    leaves = [got[i]["n_leaves"] + (not children[i]) for i in range(n)]
    saved = [got[i]["saved_tokens"] + (got[i]["n_convs"] - 1) * got[i]["chars"] for i in range(n)]
    depth = [0] * n
    for i in range(1, n):
        depth[i] = depth[skeleton.parents[i]] + 1
    for i in range(n - 1, 0, -1):
        leaves[skeleton.parents[i]] += leaves[i]
        saved[skeleton.parents[i]] += saved[i]
    return [(i, got[i]["conv_id"], depth[i], got[skeleton.parents[i]]["conv_id"] if i else None, got[i]["n_convs"],
             children[i], leaves[i], saved[i]) for i in range(n)]


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt ``conversations``.

    Rows without conv_id take no part; null turns come first; equal turn numbers go by a digest of role and text;
    repeated rows are turns of their own; an empty table has no nodes; extra columns are ignored.
    """
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").cast("long"), "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    cut = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6)).cast("int")
    origin = F.col("conv_id") - F.col("conv_id") % 100
    return trie(spark, rebuilt(turns, cut, origin))


def prefix_trie_sql() -> str:
    """The same rows in SQL, by grouping every prefix of every conversation."""
    step = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))"
    crc = (f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), "
           f"lambda x: ord(x)::BIGINT)), lambda a, b: {step}))")
    return f"""
WITH turns AS (
    SELECT conv_id, {{'n': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t
    FROM conversations WHERE conv_id IS NOT NULL),
own AS (
    SELECT conv_id, list({{'role': t.role, 'text': t.text}} ORDER BY t.n NULLS FIRST, t.role, t.text) AS p, {crc} % 6 AS h
    FROM turns GROUP BY conv_id),
whole AS (
    SELECT o.conv_id, list_concat(coalesce(b.p, [])[1:o.h], o.p[o.h + 1:]) AS p
    FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),
members AS (SELECT conv_id, d, p[1:d] AS q, len(p) = d AS ends FROM (SELECT *, unnest(range(0, len(p) + 1)) AS d FROM whole)),
nodes AS (
    SELECT q, d, min(conv_id) AS conv_id, count(*) AS n_convs,
           (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE length(q[-1].text) END AS saved,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM members GROUP BY q, d),
children AS (SELECT q[1:d - 1] AS q, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (
    SELECT q[1:a] AS q, a AS d, sum(saved) AS saved, sum(leaf) AS leaves
    FROM (SELECT n.q, n.saved, (c.n IS NULL)::INT AS leaf, unnest(range(0, n.d + 1)) AS a
          FROM nodes n LEFT JOIN children c ON c.q = n.q AND c.d = n.d) GROUP BY ALL)
SELECT n.conv_id, n.d::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
       b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.q = n.q AND b.d = n.d LEFT JOIN children c ON c.q = n.q AND c.d = n.d
LEFT JOIN nodes u ON u.d = n.d - 1 AND u.q = n.q[1:n.d - 1]"""
