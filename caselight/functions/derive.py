"""Derived case fields, bins, labels and scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caselight import fixed_values as fv
from caselight.functions.text import clean_null


def is_primary(order: Column) -> Column:
    """A submission without an order counts as the primary one."""
    return F.coalesce(order, F.lit(1)) == 1


def is_followup(order: Column) -> Column:
    return F.coalesce(order, F.lit(1)) > 1


def onset_delay(numdays: Column, vax_date: Column, onset_date: Column) -> Column:
    """Days to onset: the stored value, else the absolute gap; implausible ones are NULL.

    A stored value always wins, even when it is then dropped as implausible.
    """
    days = F.coalesce(numdays, F.abs(F.date_diff(onset_date, vax_date)))
    return F.when(days <= fv.MAX_NUMDAYS, days)


def surviving_history() -> Column:
    """Names of the history fields that still say something after cleaning."""
    return F.array_compact(
        F.array(*[F.when(clean_null(F.col(f)).isNotNull(), F.lit(f)) for f in fv.HISTORY_FIELDS])
    )


def sex_label(sex: Column) -> Column:
    return F.coalesce(F.nullif(sex, F.lit("")), F.lit("U"))


def iso_date(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def flagged(pair: tuple[str, str]) -> Column:
    column, value = pair
    return F.col(column) == value


def sql_flagged(pair: tuple[str, str]) -> str:
    column, value = pair
    return f"{column} = '{value}'"


def sql_range_bucket(column: str, buckets: dict[str, tuple[int, int | None]]) -> str:
    """SQL for the half-open bucket a value falls in; NULL when it falls in none."""
    cases = [
        f"WHEN {column} >= {low}" + ("" if high is None else f" AND {column} < {high}") + f" THEN '{label}'"
        for label, (low, high) in buckets.items()
    ]
    return f"CASE {' '.join(cases)} END"


def sql_upper_bound_bin(value: str, bins: dict[str, int | None]) -> str:
    """SQL for the first bin whose (inclusive) upper bound is not exceeded; NULL stays NULL."""
    cases = [
        f"WHEN {value} IS NOT NULL THEN '{label}'" if upper is None else f"WHEN {value} <= {upper} THEN '{label}'"
        for label, upper in bins.items()
    ]
    return f"CASE {' '.join(cases)} END"


def outcome_labels() -> Column:
    return F.array_compact(
        F.array(*[F.when(flagged(p), F.lit(label)) for label, p in fv.OUTCOME_LABELS.items()])
    )


def rate_multiplier(rate: object) -> float:
    """Under-reporting multiplier 100/rate; a missing or non-positive rate means 1."""
    try:
        value = float(rate)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return 1.0
    return 100.0 / value if value > 0 else 1.0


def scaled(count: Column, rate: object) -> Column:
    factor = rate_multiplier(rate)
    if factor == 1.0:
        return count.cast("long")
    return F.round(count * F.lit(factor)).cast("long")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100.0).otherwise(F.lit(0.0))


def over_representation(fg_share: Column, bg_share: Column) -> Column:
    """JLH score: absolute change times relative change of a term's share."""
    return (fg_share - bg_share) * (fg_share / bg_share)
