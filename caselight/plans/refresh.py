"""Bringing a published model up to a newer bronze version by the cases that changed.

Files that came, went or were replaced tell the touched cases, and these the touched buckets. Only those buckets are
built anew, from the raw rows that the model keeps by case and from the new files; every other bucket is read where
it is. Term and background counts are added to and subtracted from. The result equals a full build.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight import fixed_values as fv
from caselight.plans import model
from caselight.plans.checks import ModelError, failing_checks
from caselight.plans.mart import Mart, build_model, open_model
from caselight.sources import versions
from caselight.sources.feed import TABLE_COLUMNS
from caselight.sources.ingest import bronze_tables
from caselight.sources.star_tables import RawTables
from caselight.sources.store import LAYOUTS, ModelStore, Part, bucket_count, bucket_of

#: Beyond this share of buckets, or so many parts of one table, a full build costs less than the next refresh.
MOST_TOUCHED = 0.5
MOST_PARTS = 8
#: A full build keeps the model's buckets, and so the place of its raw rows, unless they became so many times too few.
MOST_GROWTH = 8

BY_CASE = ["raw_submissions", "raw_vaccines", "raw_terms", "vax_details", "reports", "reports_vax", "term_cases", "manu_cases",
           "narrative_grams"]


@dataclass(frozen=True)
class Refresh:
    """What a refresh did."""

    mart: Mart
    full: bool
    touched: int
    buckets: int
    bytes_read: int = 0  # of the raw rows by case: files of the touched buckets
    bytes_held: int = 0  # of the same tables in all buckets


def build_from_bronze(spark: SparkSession, bronze: str, folder: str, buckets: int | None = None) -> Mart:
    """A full build of the latest bronze version, which later refreshes go on from."""
    version = versions.version_of(spark, bronze)
    return build_model(bronze_tables(spark, bronze, version.number), spark, folder, buckets=buckets,
                       bronze_version=version.number)


def refresh_model(spark: SparkSession, bronze: str, folder: str) -> Refresh:
    """Publish a model of the latest bronze version, from the published one if that tells its own."""
    old = ModelStore.published(spark, folder)
    new = versions.version_of(spark, bronze)
    known = {v.number: v for v in versions.versions(spark, bronze)}
    if old is None or old.bronze not in known:
        mart = build_from_bronze(spark, bronze, folder)
        return Refresh(mart, True, mart.store.buckets, mart.store.buckets)
    if old.bronze == new.number:
        return Refresh(open_model(spark, folder), False, 0, old.buckets)

    gone, came = versions.changed_files(spark, bronze, known[old.bronze], new)
    rows = {t: (versions.rows_of(spark, bronze, t, gone), versions.rows_of(spark, bronze, t, came)) for t in TABLE_COLUMNS}
    cases = [df.select(fv.CASE_ID) for pair in rows.values() for df in pair]
    bucket = bucket_of(F.col(fv.CASE_ID), old.buckets).alias("bucket")
    touched = {r.bucket for r in reduce(DataFrame.unionByName, cases).select(bucket).distinct().collect()}
    parts = max((len(p) for p in old.parts.values()), default=1)
    if len(touched) > MOST_TOUCHED * old.buckets or parts >= MOST_PARTS:
        mart = _built_anew(spark, bronze, folder, old, new, gone, rows)
        return Refresh(mart, True, len(touched), old.buckets)

    store = ModelStore(spark, folder, uuid.uuid4().hex, old.buckets, bronze=new.number)
    raw = {}
    for table, (_, fresh) in rows.items():
        kept = _kept(old.load(f"raw_{table}", touched), table, gone)
        raw[table] = store.save(f"raw_{table}", kept.unionByName(fresh))
    delta = Mart(RawTables(raw["submissions"], raw["vaccines"], raw["terms"]), store)
    delta._tables.update({f"raw_{t}": df for t, df in raw.items()})

    counts = _counts_after(old.load("term_counts"), *rows["terms"])
    delta._tables["term_counts"] = store.save("term_counts", counts)
    delta._tables["symptoms"] = store.save("symptoms", model.symptoms(delta.table("term_counts").select("SYMPTOM")))
    for table in BY_CASE:
        delta.table(table)
    pairs = delta.table("reports_symptoms")
    store.parts = {t: _extended(old, t, store.version, touched) for t in BY_CASE}

    before, after = old.load("symptoms"), delta.symptoms
    old_pairs = old.load("reports_symptoms")
    replaced = old.load("reports_symptoms", touched)
    background = _background_after(old.load("symptom_bg"), before, replaced, after, pairs)
    store.save("symptom_bg", background)
    if _same_terms(before, after):
        store.parts["reports_symptoms"] = _extended(old, "reports_symptoms", store.version, touched)
    else:
        # ids are dense and alphabetical: a new or vanished term moves them, in a narrow table and without an exchange
        ids = before.join(after.select(F.col("SYMPTOM_ID").alias("_id"), "SYMPTOM"), "SYMPTOM").select("SYMPTOM_ID", "_id")
        ids = F.broadcast(ids) if model.dictionary_is_small(after) else ids
        others = old_pairs.filter(~bucket_of(F.col(fv.CASE_ID), old.buckets).isin(sorted(touched)))
        moved = others.join(ids, "SYMPTOM_ID").select(fv.CASE_ID, F.col("_id").alias("SYMPTOM_ID"))
        again = ModelStore(spark, folder, f"{store.version}-ids", store.buckets)
        again.save("reports_symptoms", moved)
        store.parts["reports_symptoms"] = (Part(again.version), Part(store.version))

    mart = Mart(None, store, readonly=True)
    failed = failing_checks(mart)
    if failed:
        raise ModelError("; ".join(f"{check}: {n}" for check, n in failed))
    store.publish()
    raws = [f"raw_{t}" for t in TABLE_COLUMNS]
    return Refresh(mart, False, len(touched), old.buckets,
                   sum(old.bytes_of(t, touched) for t in raws), sum(old.bytes_of(t) for t in raws))


def _kept(raw: DataFrame, table: str, gone: DataFrame) -> DataFrame:
    """The raw rows of the files that stay."""
    names = [r.file_name for r in gone.where(F.col("table_name") == table).select("file_name").collect()]  # one row a file
    return raw.filter(~F.col("FILE_NAME").isin(names))


def _built_anew(
    spark: SparkSession, bronze: str, folder: str, old: ModelStore, new: versions.Version, gone: DataFrame,
    rows: dict[str, tuple[DataFrame, DataFrame]],
) -> Mart:
    """A full build. Raw rows of files that stay lie by case in the model before and are not exchanged; only new files' rows are."""
    tables = bronze_tables(spark, bronze, new.number)
    if bucket_count(spark, tables.submissions, tables.vaccines, tables.terms) > MOST_GROWTH * old.buckets:
        return build_from_bronze(spark, bronze, folder)
    raw = {t: _kept(old.load(f"raw_{t}"), t, gone).unionByName(fresh.repartition(old.buckets, fv.CASE_ID))
           for t, (_, fresh) in rows.items()}
    return build_model(RawTables(raw["submissions"], raw["vaccines"], raw["terms"]), spark, folder, buckets=old.buckets,
                       bronze_version=new.number, raw_by_case=True)


def _extended(old: ModelStore, table: str, version: str, touched: set[int]) -> tuple[Part, ...]:
    """The parts of a table before, without the touched buckets, and the new part that holds them."""
    before = old.parts.get(table, (Part(old.version),))
    return (*(Part(p.version, p.without | frozenset(touched)) for p in before), Part(version))


def _counts_after(counts: DataFrame, gone: DataFrame, came: DataFrame) -> DataFrame:
    less = model.term_counts(gone).withColumn("lines", -F.col("lines"))
    whole = counts.unionByName(less).unionByName(model.term_counts(came))
    return whole.groupBy("SYMPTOM").agg(F.sum("lines").alias("lines")).filter("lines > 0")


def _background_after(bg: DataFrame, before: DataFrame, replaced: DataFrame, after: DataFrame, pairs: DataFrame) -> DataFrame:
    """Background counts by the new ids: the old ones less the replaced pairs, plus the new ones."""
    old = bg.unionByName(model.symptom_bg(replaced).withColumn("bg_n", -F.col("bg_n"))).join(before, "SYMPTOM_ID")
    new = model.symptom_bg(pairs).join(after, "SYMPTOM_ID")
    counts = old.unionByName(new).groupBy("SYMPTOM").agg(F.sum("bg_n").alias("bg_n")).filter("bg_n > 0")
    return counts.join(after, "SYMPTOM").select("SYMPTOM_ID", "bg_n")


def _same_terms(before: DataFrame, after: DataFrame) -> bool:
    both = before.select("SYMPTOM").join(after.select("SYMPTOM"), "SYMPTOM").count()
    return both == before.count() == after.count()


#: Tables whose rows a refresh and a full build must share.
COMPARED = [t for t in LAYOUTS if t != "vocabulary"]
