"""Invariants of the model; a build publishes only when none is violated."""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselight import fixed_values as fv

if TYPE_CHECKING:
    from caselight.plans.mart import Mart


class ModelError(RuntimeError):
    """A model build that must not be published."""


def _verdict(df: DataFrame, check: str, violations: Column) -> DataFrame:
    return df.agg(violations.cast("long").alias("violations")).select(
        F.lit(check).alias("check"), "violations"
    )


def repeated_keys(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once (NULLs group as equal)."""
    return df.groupBy(*key).agg(F.count("*").alias("copies")).filter("copies > 1")


def one_row_per_case(reports: DataFrame) -> DataFrame:
    extra = F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))
    return _verdict(repeated_keys(reports, fv.CASE_ID), "reports_one_row_per_case", extra)


def no_repeated_pairs(reports_symptoms: DataFrame) -> DataFrame:
    keys = repeated_keys(reports_symptoms, fv.CASE_ID, "SYMPTOM_ID")
    return _verdict(keys, "reports_symptoms_distinct", F.count("*"))


def no_repeated_triples(reports_vax: DataFrame) -> DataFrame:
    keys = repeated_keys(reports_vax, fv.CASE_ID, "VAX_TYPE", "VAX_MANU")
    return _verdict(keys, "reports_vax_distinct", F.count("*"))


def dense_term_ids(symptoms: DataFrame) -> DataFrame:
    n, low, high = F.count("*"), F.min("SYMPTOM_ID"), F.max("SYMPTOM_ID")
    dense = (n > 0) & (low == 1) & (high == n)
    return _verdict(symptoms, "symptom_ids_dense", F.when(F.coalesce(dense, F.lit(False)), 0).otherwise(1))


def vocabulary_size(symptoms: DataFrame, limit: int = fv.MAX_TERMS) -> DataFrame:
    return _verdict(symptoms, "vocabulary_fits", F.when(F.count("*") > limit, 1).otherwise(0))


def no_orphan_terms(reports_symptoms: DataFrame, symptoms: DataFrame) -> DataFrame:
    orphans = reports_symptoms.join(symptoms, "SYMPTOM_ID", "left_anti")
    return _verdict(orphans, "reports_symptoms_known_terms", F.count("*"))


def not_empty(reports: DataFrame) -> DataFrame:
    return _verdict(reports.select(fv.CASE_ID).limit(1), "reports_not_empty", 1 - F.count("*"))


def unique_lines(raw: DataFrame, table: str) -> DataFrame:
    keys = repeated_keys(raw, fv.CASE_ID, "FILE_NAME", "FILE_LINE_NO")
    return _verdict(keys, f"{table}_unique_lines", F.count("*"))


def model_checks(mart: Mart) -> DataFrame:
    """One row per build invariant: its name and the number of violations."""
    return reduce(
        DataFrame.unionByName,
        [
            one_row_per_case(mart.reports),
            no_repeated_pairs(mart.reports_symptoms),
            no_repeated_triples(mart.reports_vax),
            dense_term_ids(mart.symptoms),
            no_orphan_terms(mart.reports_symptoms, mart.symptoms),
            not_empty(mart.reports),
        ],
    )


def failing_checks(mart: Mart) -> list[tuple[str, int]]:
    return [tuple(r) for r in model_checks(mart).filter("violations > 0").collect()]
