"""Operator 4: main text of pages; a suffix array over each host finds what its pages repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.llm.html_blocks import blocks_of
from caselight.llm.shared import settled, small_side

#: HTML bytes whose pages share a suffix array, about. A larger host is dealt to several groups by a hash of the page.
GROUP_BYTES = 512_000
#: A repeated substring has this many words at least (a power of two), and this many distinct pages of its group.
RUN_WORDS, RUN_PAGES = 8, 3
#: A block goes if this share of its words lies in repeated substrings.
COVERED = 0.8


def suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix by its first ``depth`` tokens (a power of two): suffixes of equal rank share them.

    Prefix doubling; the suffix array need not be sorted beyond the length that counts as long.
    """
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < depth:
        after = np.full(len(rank), -1, np.int64)
        after[:-width or None] = rank[width:] if width < len(rank) else -1
        if width >= len(rank):
            after[:] = -1
        key = rank * (len(rank) + 2) + after + 1
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        width *= 2
    return rank


def repeated(pages: list[list[str]]) -> list[np.ndarray]:
    """Per page, which words lie in a substring of ``RUN_WORDS`` words that ``RUN_PAGES`` distinct pages hold.

    Pages of equal words are one page, so copies of a page don't cover each other.
    """
    place: dict[tuple[str, ...], int] = {}
    first = [place.setdefault(tuple(words), len(place)) for words in pages]
    covered = _repeated_in([list(words) for words in place])
    return [covered[i] for i in first]


def _repeated_in(pages: list[list[str]]) -> list[np.ndarray]:
    ids: dict[str, int] = {}
    streams, owner = [], []
    for i, words in enumerate(pages):
        # a token of its own ends each page, so no substring crosses pages
        streams.append(np.array([*(ids.setdefault(w, len(ids)) for w in words), -1 - i], np.int64))
        owner.append(np.full(len(words) + 1, i, np.int64))
    tokens, owner = np.concatenate(streams), np.concatenate(owner)
    rank = suffix_ranks(tokens, RUN_WORDS)
    pairs = np.unique(rank * (len(pages) + 1) + owner)
    distinct = np.bincount(pairs // (len(pages) + 1), minlength=int(rank.max()) + 1)
    starts = np.flatnonzero(distinct[rank] >= RUN_PAGES)
    starts = starts[starts + RUN_WORDS <= len(tokens)]
    edges = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + RUN_WORDS, -1)
    covered = np.cumsum(edges)[:-1] > 0
    ends = np.cumsum([len(s) for s in streams])
    return [covered[e - len(s) : e - 1] for s, e in zip(streams, ends)]


def main_texts(pages: list[tuple[list[str], list[bool]]]) -> list[str]:
    """Main text of each page of a group from its blocks and whether each lies in an article.

    In a page with an article its blocks are the text, however often the host repeats them; all else goes.
    In a page without one, blocks that the host's repeated substrings cover go and unique runs stay.
    """
    words = [[w for b in blocks for w in b.split()] for blocks, _ in pages]
    made = []
    for (blocks, trusted), covered in zip(pages, repeated(words)):
        if any(trusted):
            made.append("\n".join(b for b, sure in zip(blocks, trusted) if sure))
        else:
            made.append(uncovered(blocks, covered))
    return made


def uncovered(blocks: list[str], covered: np.ndarray) -> str:
    """The blocks of which repeated substrings do not cover too much, given which words of the page they cover."""
    kept, at = [], 0
    for block in blocks:
        n = len(block.split())
        share = covered[at : at + n].mean() if n else 0.0
        at += n
        if share < COVERED:
            kept.append(block)
    return "\n".join(kept)


def _digest(words: list[str]) -> bytes:
    return hashlib.blake2b("\n".join(words).encode(), digest_size=16).digest()


def _runs(pages: DataFrame) -> DataFrame:
    """(host, page, run, at): each substring of ``RUN_WORDS`` words of the distinct pages (host, page, blocks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, page, blocks in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "blocks"))):
                words = [w for b in blocks for w in b.split()]
                found = [_digest(words[i : i + RUN_WORDS]) for i in range(len(words) - RUN_WORDS + 1)]
                yield pa.RecordBatch.from_pydict({
                    "host": pa.array([host] * len(found), pa.string()), "page": pa.array([page] * len(found), pa.binary()),
                    "run": pa.array(found, pa.binary()), "at": pa.array(range(len(found)), pa.int32())})

    return pages.select("host", "page", "blocks").mapInArrow(run, "host string, page binary, run binary, at int")


def across_groups(parsed: DataFrame, open_pages: DataFrame, ids: str) -> DataFrame:
    """Texts of the pages without an article of hosts that were dealt to several groups (``open_pages``).

    What ``repeated`` tells within a group, over all pages of those hosts (``parsed``): the distinct pages that hold a
    substring are counted by its digest, if an open page holds it.
    """
    distinct = open_pages.dropDuplicates(["host", "page"])
    sought = _runs(distinct)
    held = _runs(parsed).select("host", "page", "run").distinct()
    repeats = held.join(sought.select("host", "run").distinct(), ["host", "run"], "left_semi").groupBy("host", "run").agg(
        F.count("*").alias("pages")).filter(F.col("pages") >= RUN_PAGES)
    places = sought.join(repeats, ["host", "run"]).groupBy("host", "page").agg(F.collect_list("at").alias("starts"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for blocks, starts in zip(batch.column("blocks").to_pylist(), batch.column("starts").to_pylist()):
                covered = np.zeros(sum(len(b.split()) for b in blocks), bool)
                for at in starts or []:
                    covered[at : at + RUN_WORDS] = True
                made.append(uncovered(blocks, covered))
            yield pa.RecordBatch.from_pydict({
                "page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(made, pa.string()),
                "n_chars": pa.array([len(t) for t in made], pa.int64())})

    rows = open_pages.join(places, ["host", "page"], "left").select("page_id", "url", "blocks", "starts")
    return rows.mapInArrow(texts, f"{ids}, text string, n_chars long")


def extracted(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    Pages are parsed where they are read; only their blocks are shuffled, to groups of bounded size within
    a host. A host's size is summed map-side and decides over how many groups its pages are dealt, so a
    host with a third of all pages takes many tasks. Pages without an article of hosts of several groups are
    settled afterwards, by what all pages of the host repeat.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)),
                      F.lit(""))
    pages = pages.select("page_id", "url", "html").withColumn("host", host)
    hosts = settled(spark, pages.groupBy("host").agg(
        (F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 64) / GROUP_BYTES + 1).cast("long").alias("groups")), "hosts")
    # by what the row holds, so that a table that is partitioned otherwise gives the same groups
    place = F.xxhash64("page_id", "url", "html")
    dealt = pages.join(small_side(hosts), "host").withColumn("part", F.pmod(place, F.col("groups")))
    kinds = dict(pages.dtypes)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks_of(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c) for c in ("page_id", "url", "host", "part", "groups")},
                "blocks": pa.array([[b.text for b in page] for page in found], pa.list_(pa.string())),
                "trusted": pa.array([[b.trusted for b in page] for page in found], pa.list_(pa.bool_())),
            })

    def clean(table: pa.Table) -> pa.Table:
        found = list(zip(table["blocks"].to_pylist(), table["trusted"].to_pylist()))
        texts = main_texts(found)
        several = table["groups"][0].as_py() > 1
        left = [several and bool(blocks) and not any(trusted) for blocks, trusted in found]
        return pa.table({"page_id": table["page_id"], "url": table["url"], "text": pa.array(texts, pa.string()),
                         "n_chars": pa.array([len(t) for t in texts], pa.int64()), "left": pa.array(left, pa.bool_())})

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = [_digest([w for b in blocks for w in b.split()]) for blocks in batch.column("blocks").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c) for c in ("page_id", "url", "host", "blocks")}, "page": pa.array(pages, pa.binary())})

    ids, shown = f"page_id {kinds['page_id']}, url {kinds['url']}", ["page_id", "url", "text", "n_chars"]
    as_parsed = f"{ids}, host string, part long, groups long, blocks array<string>, trusted array<boolean>"
    as_named = f"{ids}, host string, blocks array<string>, page binary"
    made = dealt.mapInArrow(parse, as_parsed).groupBy("host", "part").applyInArrow(
        clean, f"{ids}, text string, n_chars long, left boolean")
    # parsed once more rather than written: texts and blocks of all pages take much disk, open pages are few
    several = dealt.filter("groups > 1").mapInArrow(parse, as_parsed)
    left = several.filter("size(blocks) > 0 AND NOT exists(trusted, t -> t)").mapInArrow(named, as_named)
    if hosts.filter("groups > 1").isEmpty():
        return made.select(*shown)
    open_pages = settled(spark, left, "open-pages")
    if open_pages.isEmpty():
        return made.select(*shown)
    again = several.join(open_pages.select("host").distinct(), "host", "left_semi").select(*several.columns)
    return made.filter("NOT left").select(*shown).unionByName(
        across_groups(again.mapInArrow(named, as_named), open_pages, ids))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page.

    Null or empty html gives empty text; pages without a url form a host of their own; repeated rows and copies
    of a page each give a row with the text that one of them would have; an empty table gives no rows; other columns
    are ignored.
    """
    return extracted(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
