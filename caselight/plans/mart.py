"""The case model as a set of named tables, built when first asked for."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Collection, Hashable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import fields

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from caselight import fixed_values as fv
from caselight.plans import model
from caselight.plans.checks import ModelError, failing_checks
from caselight.session import shared_folder
from caselight.sources.star_tables import RawTables, raw_tables
from caselight.sources.store import ModelStore, bucket_count

MODEL_TABLES = [
    "vax_details", "reports", "reports_vax", "symptoms", "reports_symptoms", "symptom_bg",
]
#: What a published model holds besides: postings for filters, raw rows by case for dossiers, counts for refreshes.
SERVED_TABLES = ["term_counts", "term_cases", "manu_cases", "narrative_grams", "raw_submissions", "raw_vaccines", "raw_terms"]


class Mart:
    """Raw tables plus the written model tables of one store version.

    A table is written the first time something needs it and read back from then on, so every
    query over it starts from a narrow, bucketed, prunable scan.
    """

    def __init__(self, raw: RawTables | None, store: ModelStore, readonly: bool = False, raw_by_case: bool = False):
        self.raw = raw
        self.store = store
        self.spark = store.spark
        self._readonly = readonly
        self._raw_by_case = raw_by_case  # the raw rows lie by case bucket already
        self._by_case = False
        self._tables: dict[str, DataFrame] = {}
        self._selections: dict[Hashable, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            if self._readonly:
                self._tables[name] = self.store.load(name)
            else:
                in_place = self._raw_by_case if name.startswith("raw_") else self._by_case
                self._tables[name] = self.store.save(name, self._define(name), in_place)
        return self._tables[name]

    def _define(self, name: str) -> DataFrame:
        partitions = None if self._by_case else self.store.buckets
        if name == "reports":
            return model.reports(self.raw.submissions, self.vax_details, partitions)
        if name == "reports_vax":
            return model.reports_vax(self.vax_details)
        if name == "vax_details":
            return model.vax_details(self.raw.vaccines, partitions)
        if name == "vocabulary":
            return model.vocabulary(self.raw.terms)
        if name == "symptoms":
            return model.symptoms(self.table("term_counts").select("SYMPTOM"))
        if name == "reports_symptoms":
            small = model.dictionary_is_small(self.symptoms)
            return model.reports_symptoms(self.raw.terms, self.symptoms, self.reports, small, partitions)
        if name == "symptom_bg":
            return model.symptom_bg(self.reports_symptoms)
        if name == "term_counts":
            return model.term_counts(self.raw.terms)
        if name == "term_cases":
            return model.term_cases(self.reports_symptoms, self.symptoms, model.dictionary_is_small(self.symptoms))
        if name == "manu_cases":
            return model.manu_cases(self.reports_vax)
        if name == "narrative_grams":
            return model.narrative_grams(self.reports, self.store.buckets)
        if name.startswith("raw_"):
            return getattr(self.raw, name.removeprefix("raw_"))
        raise KeyError(name)

    def holds(self, name: str) -> bool:
        """Whether a table is written already; an index that is not is no use to a single search."""
        return self._readonly or name in self._tables

    def reports_in(self, buckets: Collection[int]) -> DataFrame:
        """The cases of some buckets; files of the others are not read."""
        self.table("reports")
        return self.store.load("reports", buckets)

    def selection(self, key: Hashable, find: Callable[[], DataFrame]) -> DataFrame:
        """Cases found by a costly search, written once per key and read back from then on."""
        if key not in self._selections:
            self._selections[key] = self.store.save(f"selection_{uuid.uuid4().hex}", find())
        return self._selections[key]

    def forget_selections(self) -> None:
        """Search anew from now on (the written selections stay until the folder is cleaned)."""
        self._selections.clear()

    def build_all(self) -> None:
        """Write every table; those that do not need each other are written side by side, so
        the tail of one job does not leave the cluster idle."""
        with ThreadPoolExecutor(2) as pool:
            for independent in (["vax_details", "symptoms"], ["reports", "reports_vax"]):
                list(pool.map(inheritable_thread_target(self.spark)(self.table), independent))
        for name in MODEL_TABLES:
            self.table(name)

    def file_by_case(self) -> None:
        """Write the raw rows by case bucket and go on from there: what follows needs no exchange by case."""
        names = [f.name for f in fields(RawTables)]
        with ThreadPoolExecutor(len(names)) as pool:
            filed = list(pool.map(inheritable_thread_target(self.spark)(self.table), [f"raw_{n}" for n in names]))
        self.raw = RawTables(*filed)
        self._by_case = True

    def build_served(self) -> None:
        """Write what a published model holds besides the case model."""
        with ThreadPoolExecutor(2) as pool:
            list(pool.map(inheritable_thread_target(self.spark)(self.table), SERVED_TABLES))

    reports = property(lambda self: self.table("reports"))
    reports_vax = property(lambda self: self.table("reports_vax"))
    vax_details = property(lambda self: self.table("vax_details"))
    symptoms = property(lambda self: self.table("symptoms"))
    reports_symptoms = property(lambda self: self.table("reports_symptoms"))
    symptom_bg = property(lambda self: self.table("symptom_bg"))

    def register_views(self, prefix: str = "", id_name: str = fv.CASE_ID) -> None:
        """Offer every table to plain SQL, with the case id under any name."""
        frames = {name: self.table(name) for name in MODEL_TABLES}
        if self.raw is not None:
            frames |= {
                "submissions": self.raw.submissions,
                "vaccines": self.raw.vaccines,
                "terms": self.raw.terms,
            }
        for name, df in frames.items():
            df.withColumnRenamed(fv.CASE_ID, id_name).createOrReplaceTempView(prefix + name)


def build_model(
    raw: RawTables,
    spark: SparkSession,
    folder: str,
    max_terms: int | None = None,
    buckets: int | None = None,
    bronze_version: int | None = None,
    raw_by_case: bool = False,
) -> Mart:
    """Write a new version, check it, and only then publish it.

    ``bronze_version`` says which version of the bronze tables ``raw`` is; ``plans.refresh`` goes on from there.
    ``raw_by_case`` says that the rows of ``raw`` lie in ``buckets`` by case already, so that they need not move.

    ``max_terms`` stops a build with a larger vocabulary, for readers whose term ids are narrow.
    """
    if buckets is None:
        buckets = bucket_count(spark, raw.submissions, raw.vaccines, raw.terms)
    store = ModelStore(spark, folder, uuid.uuid4().hex, buckets, bronze=bronze_version)
    mart = Mart(raw, store, raw_by_case=raw_by_case)
    mart.file_by_case()
    if max_terms is not None:
        found = mart.table("term_counts").count()
        if found > max_terms:
            raise ModelError(f"vocabulary of {found} terms exceeds {max_terms}")
    mart.build_all()
    failed = failing_checks(mart)
    if failed:
        raise ModelError("; ".join(f"{check}: {n}" for check, n in failed))
    mart.build_served()
    store.publish()
    return mart


def open_model(spark: SparkSession, folder: str, raw: RawTables | None = None) -> Mart:
    """The latest published model of a folder."""
    store = ModelStore.published(spark, folder)
    if store is None:
        raise ModelError(f"no published model in {folder}")
    return Mart(raw, store, readonly=True)


def model_is_usable(spark: SparkSession, folder: str) -> bool:
    store = ModelStore.published(spark, folder)
    return store is not None and not store.load("reports").isEmpty()


_session_marts: dict[tuple[str, str], Mart] = {}


def session_mart(spark: SparkSession, folder: str) -> Mart:
    """The mart over a folder of star tables, shared by all queries of one application."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _session_marts:
        target = f"{shared_folder(spark)}/caselight/{key[0]}"
        raw = raw_tables(spark, folder)
        buckets = bucket_count(spark, raw.submissions, raw.vaccines, raw.terms)
        raw = raw_tables(spark, folder, buckets)
        _session_marts[key] = Mart(raw, ModelStore(spark, target, uuid.uuid4().hex, buckets))
    return _session_marts[key]
