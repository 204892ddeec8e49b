"""Terms that stand out: most reported overall, or over-represented in a selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight import fixed_values as fv
from caselight.functions.derive import over_representation, scaled
from caselight.plans.mart import Mart


def top_terms(mart: Mart, rate: object = None, top: int = fv.TOP_LABELS) -> DataFrame:
    """Most reported terms over all cases, from the stored background counts."""
    return (
        mart.symptom_bg.join(mart.symptoms, "SYMPTOM_ID")
        .orderBy(F.desc("bg_n"), F.asc("SYMPTOM"))
        .limit(top)
        .select(F.col("SYMPTOM").alias("symptom"), scaled(F.col("bg_n"), rate).alias("count"))
    )


def significant_terms(
    mart: Mart, cases: DataFrame, rate: object = None, top: int = fv.TOP_SIGNIFICANT
) -> DataFrame:
    """Terms whose share among ``cases`` most exceeds their share among all cases.

    Totals are scalar subqueries; the pair table meets the selection on the case key both are
    bucketed by; names are looked up only for terms that pass the thresholds. Counts are
    rate-scaled after scoring.
    """
    selected = cases.select(fv.CASE_ID)
    selected_total = selected.agg(F.count("*").cast("double")).scalar()
    all_total = mart.reports.agg(F.count("*").cast("double")).scalar()
    foreground = (
        mart.reports_symptoms.join(selected, fv.CASE_ID, "left_semi")
        .groupBy("SYMPTOM_ID")
        .agg(F.count("*").alias("fg_n"))
        .filter(F.col("fg_n") >= fv.MIN_FOREGROUND)
    )
    background = mart.symptom_bg.filter(F.col("bg_n") >= fv.MIN_BACKGROUND)
    shares = (
        foreground.join(background, "SYMPTOM_ID")
        .withColumn("fg_share", F.col("fg_n") / selected_total)
        .withColumn("bg_share", F.col("bg_n") / all_total)
        .filter(F.col("fg_share") > F.col("bg_share"))
    )
    return (
        shares.withColumn("score", over_representation(F.col("fg_share"), F.col("bg_share")))
        .join(mart.symptoms, "SYMPTOM_ID")
        .orderBy(F.desc("score"), F.desc("fg_n"), F.asc("SYMPTOM"))
        .limit(top)
        .select(
            F.col("SYMPTOM").alias("symptom"),
            scaled(F.col("fg_n"), rate).alias("fg_n"),
            scaled(F.col("bg_n"), rate).alias("bg_n"),
            "score",
        )
    )


def top_terms_for_type(mart: Mart, vax_type: str, top: int = 10) -> DataFrame:
    """Most reported terms among cases with a vaccine type."""
    takers = mart.reports_vax.filter(F.col("VAX_TYPE") == vax_type).select(fv.CASE_ID)
    return (
        mart.reports_symptoms.join(takers, fv.CASE_ID, "left_semi")
        .groupBy("SYMPTOM_ID")
        .agg(F.count("*").alias("n"))
        .join(mart.symptoms, "SYMPTOM_ID")
        .orderBy(F.desc("n"), F.asc("SYMPTOM"))
        .limit(top)
        .select("SYMPTOM", "n")
    )
