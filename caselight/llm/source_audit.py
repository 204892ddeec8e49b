"""Operator 13: how far the word use of each source lies from the other sources and from its language.

Tokenizing is one ``bytes.translate`` (letters A-Z lowered, every separator blanked) and one ``bytes.split``;
a ``Counter`` per document gives its terms and their frequencies, which tasks add up in sparse tables.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselight.llm.shared import documents_of, settled, small_side

#: Separators are the ASCII bytes that are no letters; bytes from 0x80 on belong to terms.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

LEAST_DOCUMENTS = 30
SCALE = 1_000_000_000
ADDED = 5
TOP_TERMS = 50

#: Terms a task holds before it writes its counts out.
HELD_TERMS = 300_000

#: Entries of one dense matrix of sources and terms, as long as it has ``LEFT`` terms.
CELLS = 1 << 16

#: Sources on the left side of one comparison, and least terms of a block: what a block sends is no more than it reads.
LEFT = 256

COUNTS = "lang string, source string, term string, docs long, n long"
DIVERGENCE = "lang string, source string, item string, value long"

#: One document of a term, in a number whose lower bits count occurrences.
_DOCUMENT = 1 << 64


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: documents and occurrences of each term by language and source; term '' counts the documents."""
    tables: dict[tuple[str, str], dict[bytes, int]] = defaultdict(dict)
    size = 0

    def written() -> Iterator[pa.RecordBatch]:
        for (lang, source), table in tables.items():
            packed = list(table.values())
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(table), pa.string()), "source": pa.array([source] * len(table), pa.string()),
                "term": pa.array(list(table), pa.binary()).cast(pa.string()),
                "docs": pa.array([p >> 64 for p in packed], pa.int64()),
                "n": pa.array([p & (_DOCUMENT - 1) for p in packed], pa.int64())})
        tables.clear()

    for batch in batches:
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"], strict=True):
            table = tables[lang, source]
            before = len(table)
            terms = Counter(text.as_py().translate(TABLE).split())
            terms[b""] = 1
            held = table.get
            for term, n in terms.items():
                table[term] = held(term, 0) + _DOCUMENT + n
            size += len(table) - before
            if size > HELD_TERMS:
                yield from written()
                size = 0
    yield from written()


def _distances(table: pa.Table) -> pa.Table:
    """Summed differences of all sources of one language over one block of terms; later sources pair with earlier ones.

    Rows without a term name every source and its value for terms it does not use.
    """
    lang, chunk = table["lang"][0].as_py(), table["_chunk"][0].as_py()
    source, term = table["source"].to_numpy(zero_copy_only=False), table["term"].to_numpy(zero_copy_only=False)
    p = table["p"].to_numpy()
    base = table["term"].is_null().to_numpy(zero_copy_only=False)
    order = np.argsort(source[base], kind="stable")
    names, absent = source[base][order], p[base][order]
    rows = np.searchsorted(names, source[~base])
    _, columns = np.unique(term[~base], return_inverse=True)
    width = int(columns.max()) + 1 if len(columns) else 0
    dense = np.repeat(absent[:, None], width, axis=1)
    dense[rows, columns] = p[~base]
    out: dict[str, list] = {"source": [], "item": [], "value": []}
    for i in range(chunk * LEFT, min((chunk + 1) * LEFT, len(names))):
        out["source"].append(np.repeat(names[i : i + 1], len(names) - i - 1))
        out["item"].append(names[i + 1 :])
        out["value"].append(np.abs(dense[i + 1 :] - dense[i]).sum(axis=1, dtype=np.int64))
    joined = {k: np.concatenate(v) if v else np.empty(0, object) for k, v in out.items()}
    return pa.table({
        "lang": pa.array([lang] * len(joined["value"]), pa.string()), "source": pa.array(joined["source"], pa.string()),
        "item": pa.array(joined["item"], pa.string()), "value": pa.array(joined["value"], pa.int64())})


def _share(count, total, terms):
    """``1 + floor(SCALE * (count + ADDED) / (total + ADDED * terms))``, exact for any long counts."""
    wide = f"cast({SCALE} as decimal(10,0)) * cast({count} + {ADDED} as decimal(20,0))"
    return F.expr(f"1 + ({wide}) div cast({total} + {ADDED} * {terms} as decimal(20,0))")


def divergence(spark: SparkSession, docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank of ``docs`` (text, lang, source; nulls count as '').

    A term is kept in a language if ``least`` of its rows hold it (repeated rows count each). ``part`` is ``pair``
    (each other source of the language, all ranks) or ``term`` (what the source uses more than its language, ranks
    to ``top``). Texts without terms count as documents of their source; an empty table gives no rows; other columns
    are ignored. Each task sends a term once for each source, so frequent terms and hot sources are small after the
    first exchange. Sources of a language are compared over blocks of terms: a block holds about ``CELLS`` values, and ``LEFT`` terms at least.
    """
    blank = F.lit("")
    docs = docs.select(F.coalesce("lang", blank).alias("lang"), F.coalesce("source", blank).alias("source"),
                       F.coalesce("text", blank).cast("binary").alias("text"))
    counts = docs.mapInArrow(term_counts, COUNTS).groupBy("lang", "source", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    counts = settled(spark, counts, "source-terms")
    terms = settled(spark, counts.where("term <> ''").groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least).drop("docs"), "kept-terms")
    sparse = counts.where("term <> ''").join(small_side(terms), ["lang", "term"]).select(
        "lang", "source", "term", "n", "lang_n")
    sparse = settled(spark, sparse, "sparse-terms")

    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    own = sparse.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").join(
        langs, "lang", "left").select(
        "lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "lang_total")))
    groups = groups.withColumn("absent", F.when(F.col("terms") > 0, _share("0L", "total", "terms")).otherwise(F.lit(0)))
    groups = settled(spark, groups, "sources")
    named = sparse.join(small_side(groups), ["lang", "source"]).select(
        "lang", "source", "term", _share("n", "total", "terms").alias("p"),
        _share("lang_n", "lang_total", "terms").alias("q"))
    named = settled(spark, named, "shares")
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    used = ranked(named.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                              (F.col("p") - F.col("q")).alias("value")))

    # blocks of terms, and for each block all sources of the language
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.max("terms").alias("terms"))
    width = F.greatest(F.lit(LEFT), F.floor(F.lit(CELLS) / F.col("sources")))
    sizes = sizes.select("lang", F.ceil(F.greatest(F.col("terms"), F.lit(1)) / width).cast("int").alias("blocks"),
                         F.ceil(F.col("sources") / LEFT).cast("int").alias("chunks"))
    sizes = settled(spark, sizes, "blocks")
    chunks = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("_chunk")
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    cells = named.join(small_side(sizes), "lang").select("lang", block.alias("_block"), chunks, "source", "term", "p")
    bases = groups.join(small_side(sizes), "lang").select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_block"), "chunks", "source",
        F.lit(None).cast("string").alias("term"), F.col("absent").alias("p")).select(
        "lang", "_block", chunks, "source", "term", "p")
    apart = cells.unionByName(bases).groupBy("lang", "_block", "_chunk").applyInArrow(_distances, DIVERGENCE)
    apart = apart.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    apart = apart.select("lang", both.alias("_pair"), "value").select(
        "lang", "_pair.source", F.lit("pair").alias("part"), "_pair.item", "value")
    return ranked(apart).unionByName(used.where(F.col("rank") <= top))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources of ``documents``; see ``divergence``."""
    return divergence(spark, documents_of(spark, sf_dir))


def source_audit_sql() -> str:
    """The same rows in SQL: every kept term of a language for every source, without any sparsity."""
    share = lambda c, n, v: f"1 + ({SCALE}::HUGEINT * ({c} + {ADDED})) // ({n} + {ADDED} * {v})"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH docs AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), '{upper}', '{lower}') AS text FROM documents),
words AS (SELECT d, lang, source,
                 unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= {LEAST_DOCUMENTS}),
langs AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
sources AS (SELECT DISTINCT lang, source FROM docs),
used AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term
         GROUP BY ALL),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM used GROUP BY ALL),
shares AS (
    SELECT s.lang, s.source, k.term, coalesce(u.n, 0) AS n,
           {share("coalesce(u.n, 0)", "coalesce(t.total, 0)", "l.v")} AS p, {share("k.n", "l.total", "l.v")} AS q
    FROM sources s JOIN kept k ON k.lang = s.lang JOIN langs l ON l.lang = s.lang
    LEFT JOIN used u ON u.lang = s.lang AND u.source = s.source AND u.term = k.term
    LEFT JOIN totals t ON t.lang = s.lang AND t.source = s.source),
apart AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
    FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked
WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
