"""Operator 3: secret scans over a trigram index (SQL functions only)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.llm.secret_rules import BASE_KINDS, RULES, Rule, trigram_query
from caselight.llm.shared import documents_of, settled, small_side

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def postings(docs: DataFrame, key: str, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(trigram, key) for the trigrams that some rule's query names, one row per pair and input row."""
    wanted = sorted({t for r in rules for clause in trigram_query(r.pattern) for alt in clause for t in alt})
    folded = F.translate(F.col(text), UPPER, LOWER)
    found = F.filter(F.array(*map(F.lit, wanted)), lambda t: F.contains(F.col("_folded"), t))
    return docs.select(F.col(key), folded.alias("_folded")).select(F.explode(found).alias("trigram"), key)


def candidates(index: DataFrame, key: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, kinds): rules whose query holds for a key. Posting lists meet by key; a key has few trigrams."""
    lists = index.groupBy(key).agg(F.collect_set("trigram").alias("_trigrams"))

    def holds(rule: Rule) -> Column:
        clauses = [
            reduce(lambda a, b: a | b, [
                F.size(F.array_except(F.array(*map(F.lit, sorted(alt))), F.col("_trigrams"))) == 0
                for alt in sorted(clause, key=sorted)])
            for clause in trigram_query(rule.pattern)]
        return reduce(lambda a, b: a & b, clauses)

    kinds = F.array_compact(F.array(*[
        F.when(holds(r), F.lit(r.kind)) for r in rules if trigram_query(r.pattern)]))
    return lists.select(key, kinds.alias("_kinds")).where(F.size("_kinds") > 0)


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, number, end) in code points: leftmost non-overlapping matches that count.

    What lies between the matches comes from splitting at them; lengths of both give the places.
    """
    pattern = f"(?i){rule.pattern}" if rule.any_case else rule.pattern
    if rule.least and re.fullmatch(r"\[[^\]]+\]\+", rule.pattern):
        # a run of one class of characters: too short runs need not be made first
        pattern = f"{pattern[:-1]}{{{rule.least},}}"
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)),
                          lambda t: F.length(t) >= rule.least)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), F.transform(hits, F.length),
                       lambda g, n: F.struct(g.alias("gap"), n.alias("n")))
    none = F.array().cast("array<struct<start:int,number:int,end:int>>")
    place = lambda a, x: F.struct(
        (a["at"] + x["gap"]).alias("start"), F.lit(number).alias("number"),
        (a["at"] + x["gap"] + x["n"]).alias("end"))
    walked = F.aggregate(
        steps, F.struct(F.lit(0).alias("at"), none.alias("found")),
        lambda a, x: F.struct((a["at"] + x["gap"] + x["n"]).alias("at"),
                              F.concat(a["found"], F.array(place(a, x))).alias("found")))["found"]
    kept = F.transform(
        F.filter(F.arrays_zip(walked.alias("s"), counted.alias("k")), lambda x: x["k"]), lambda x: x["s"])
    return F.when(F.regexp_like(text, F.lit(pattern)), kept).otherwise(none)


def with_spans(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text",
               rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``_spans``: sorted array of (start, number of the rule, end). Null text has none.

    The index is built over every text; rules with mandatory trigrams are verified on the texts that
    their postings leave, other rules on all texts. Candidates are one narrow row per key and are
    broadcast only if counted to be few; else they are joined by key.
    """
    index = postings(docs, key, text, rules)
    few = settled(spark, candidates(index, key, rules), "secret-candidates")
    few = small_side(few.withColumnRenamed(key, "_key"))
    joined = docs.join(few, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")

    def found(number: int, rule: Rule) -> Column:
        spans = spans_of(F.col(text), rule, number)
        if not trigram_query(rule.pattern):
            return spans
        none = F.array().cast("array<struct<start:int,number:int,end:int>>")
        return F.when(F.array_contains("_kinds", rule.kind), spans).otherwise(none)

    parts = [F.coalesce(found(i, r), F.array().cast("array<struct<start:int,number:int,end:int>>"))
             for i, r in enumerate(rules)]
    return joined.withColumn("_spans", F.array_sort(F.concat(*parts))).drop("_kinds")


def listed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end``, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["number"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with each stretch covered by spans replaced by ``mark``."""
    step = lambda a, s: F.struct(
        F.when(s["start"] >= a["at"], F.concat(
            a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)))
        .otherwise(a["out"]).alias("out"),
        F.greatest(a["at"], s["end"]).alias("at"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(spans, start, step, lambda a: F.concat(
        a["out"], F.substring(text, a["at"] + 1, F.greatest(F.length(text) - a["at"], F.lit(0)))))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base counts, digest of the base spans, all spans.

    Null and empty texts have none; repeated rows each give a row; null doc_ids are scanned like others;
    an empty table gives no rows; other columns are ignored.
    """
    docs = documents_of(spark, sf_dir).select("doc_id", "text")
    found = with_spans(spark, docs)
    count = lambda i: F.size(F.filter("_spans", lambda s: s["number"] == i)).cast("long")
    base = F.filter("_spans", lambda s: s["number"] < len(BASE_KINDS))
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"))
