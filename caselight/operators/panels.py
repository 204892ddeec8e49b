"""The named aggregate panels over filtered cases.

A *case panel* names, per case, its label or labels (NULL where the case is not counted). Any
number of case panels is counted in ONE scan: ``stack`` turns a case into its (panel, label)
rows and a single map-side-combined aggregate counts them. Fixed domains are zero-filled by
adding weightless rows before that aggregate, not by a join after.

A *vaccine panel* counts distinct cases per label of a per-case vaccine table. Both sides are
bucketed by case, so neither the semi join nor the per-case distinct needs an exchange.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caselight import fixed_values as fv
from caselight.functions import derive
from caselight.functions.text import sql_trim_spaces
from caselight.operators.filters import FilterSpec, selected_cases
from caselight.operators.signals import significant_terms, top_terms
from caselight.plans.mart import Mart



@dataclass(frozen=True)
class CasePanel:
    """``labels``: SQL for the labels of a case, NULL where it is not counted.

    ``series`` panels are placed by their label (a year or month), the others by ``domain``,
    the labels shown even when nothing falls on them.
    """

    label_name: str
    labels: Sequence[str]
    label_type: str = "string"
    domain: Sequence[object] = ()
    series: bool = False
    by_count: bool = False  # most frequent first instead of by position
    top: int | None = None
    drop_zero: bool = False


@dataclass(frozen=True)
class VaccinePanel:
    """``label``: SQL over a per-case vaccine table, NULL where a row is not counted."""

    label_name: str
    table: str
    label: str
    top: int = fv.TOP_LABELS


def _when(condition: str, label: str) -> str:
    return f"CASE WHEN {condition} THEN {label} END"


def _flags(flags: dict[str, str]) -> list[str]:
    return [_when(condition, f"'{name}'") for name, condition in flags.items()]


def _years(date: str, condition: str = "TRUE") -> CasePanel:
    return CasePanel("year", [_when(condition, f"year({date})")], "bigint", series=True)


def _numbers(name: str, condition: str, value: str, domain: range) -> CasePanel:
    return CasePanel(name, [_when(condition, value)], "bigint", domain=domain)


def _bins(name: str, label: str, bins: dict) -> CasePanel:
    return CasePanel(name, [label], domain=list(bins))


def _top(name: str, column: str) -> CasePanel:
    return CasePanel(name, [_when(f"{column} <> ''", column)], by_count=True, top=fv.TOP_LABELS)


def _flag_panel(name: str, flags: dict[str, str], **how) -> CasePanel:
    return CasePanel(name, _flags(flags), domain=list(flags), **how)


CASE_PANELS: dict[str, CasePanel] = {
    "total": _flag_panel("label", {"total": "TRUE"}),
    "reactions": _flag_panel(
        "reaction", {name: derive.sql_flagged(pair) for name, pair in fv.REACTIONS.items()},
        by_count=True, drop_zero=True),
    "events_by_year": _years("VAX_DATE"),
    "sparkline": CasePanel("period", ["date_format(VAX_DATE, 'yyyy-MM')"], series=True),
    "onset_days": _numbers("day", "NUMDAYS BETWEEN 0 AND 19", "NUMDAYS", fv.ONSET_DAYS),
    "num_vax": _numbers("num", "NUM_VAX BETWEEN 1 AND 8", "NUM_VAX", fv.NUM_VAX_RANGE),
    "age": _bins("label", derive.sql_range_bucket("AGE_YRS", fv.AGE_BUCKETS), fv.AGE_BUCKETS),
    "age_u20": _numbers(
        "age", "AGE_YRS >= 0 AND AGE_YRS < 20", "CAST(floor(AGE_YRS) AS INT)", fv.SINGLE_YEARS),
    "sex": CasePanel("sex", ["coalesce(nullif(SEX, ''), 'U')"], by_count=True),
    "states": _top("state", "STATE"),
    "lag": _bins(
        "bucket", derive.sql_upper_bound_bin("datediff(RECVDATE, VAX_DATE)", fv.LAG_BINS), fv.LAG_BINS),
    # deaths without a date carry the label "missing", at position 0
    "deaths": CasePanel(
        "year", [_when("DIED = 'Y'", "coalesce(CAST(year(DATEDIED) AS STRING), 'missing')")],
        domain=["missing"], series=True),
    "v_adminby": _top("label", "V_ADMINBY"),
    "v_fundby": _top("label", "V_FUNDBY"),
    "vax_combos": _top("label", "VAX_COMBO"),
    "has_data": _flag_panel(
        "label", {name: f"array_contains(HAS_DATA, '{name}')" for name in fv.HISTORY_FIELDS},
        by_count=True, drop_zero=True),
    "events_by_recvdate": _years("RECVDATE"),
    "no_vaxdate_by_recvdate": _years("RECVDATE", "VAX_DATE IS NULL"),
    "no_vaxdate_pct": _flag_panel("label", {"missing": "VAX_DATE IS NULL", "total": "TRUE"}),
    "died_series": _years("VAX_DATE", "DIED = 'Y'"),
    "followup_dist": _bins(
        "bucket", derive.sql_upper_bound_bin("FOLLOWUP_COUNT", fv.FOLLOWUP_BINS), fv.FOLLOWUP_BINS),
}


def _raw_label(column: str, *excluded: str) -> str:
    """A raw vaccine attribute that is not blank and not one of the junk spellings."""
    junk = ", ".join(f"'{text}'" for text in ("", *excluded))
    return _when(f"lower({sql_trim_spaces(column)}) NOT IN ({junk})", column)


VACCINE_PANELS: dict[str, VaccinePanel] = {
    "vax_types": VaccinePanel("vax_type", "reports_vax", "VAX_TYPE"),
    "manufacturers": VaccinePanel(
        "manu", "reports_vax", _when("VAX_MANU <> ''", "VAX_MANU"), fv.TOP_MANUFACTURERS),
    "vax_route": VaccinePanel("label", "vax_details", _raw_label("VAX_ROUTE")),
    "vax_site": VaccinePanel("label", "vax_details", _raw_label("VAX_SITE")),
    "vax_dose_series": VaccinePanel("label", "vax_details", _raw_label("VAX_DOSE_SERIES")),
    "vax_lot": VaccinePanel("label", "vax_details", _raw_label("VAX_LOT", *fv.JUNK_LOTS)),
}


PANEL_KEYS = [*CASE_PANELS, *VACCINE_PANELS, "symptoms"]


class PanelError(ValueError):
    """A panel request that cannot be answered."""


def requested_panels(keys: Sequence[object] | None) -> list[str]:
    """Validated, de-duplicated panel keys; None means the default set."""
    if keys is None:
        return list(fv.VIEWS[fv.DEFAULT_VIEW][0])
    if isinstance(keys, str) or not 1 <= len(keys) <= fv.MAX_PANEL_KEYS:
        raise PanelError("panels must be a non-empty list of panel keys")
    wanted = list(dict.fromkeys(str(k) for k in keys))
    unknown = [k for k in wanted if k not in PANEL_KEYS]
    if unknown:
        raise PanelError(f"unknown panel key(s): {', '.join(unknown)}")
    return wanted


# --- counting -----------------------------------------------------------------


def count_cases(cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(panel, label, pos, n) of any number of case panels, in one scan of ``cases``."""
    cells = [f"'{key}', CAST({label} AS STRING)" for key in keys for label in CASE_PANELS[key].labels]
    hits = cases.selectExpr(f"stack({len(cells)}, {', '.join(cells)}) AS (panel, label)").filter(
        "label IS NOT NULL"
    )
    rows = hits.selectExpr("panel", "label", "CAST(NULL AS INT) AS pos", "1L AS n")
    zeros = [
        f"('{key}', '{label}', {place}, 0L)"
        for key in keys
        # a domain label of a series comes before all its years
        for place, label in enumerate(CASE_PANELS[key].domain, 0 if CASE_PANELS[key].series else 1)
    ]
    if zeros:
        rows = rows.union(cases.sparkSession.sql(f"VALUES {', '.join(zeros)}"))
    counts = rows.groupBy("panel", "label").agg(F.max("pos").alias("pos"), F.sum("n").alias("n"))
    series = [f"'{key}'" for key in keys if CASE_PANELS[key].series]
    if not series:
        return counts
    by_label = f"CASE WHEN panel IN ({', '.join(series)}) THEN try_cast(replace(label, '-') AS INT) END"
    return counts.selectExpr("panel", "label", f"coalesce(pos, {by_label}) AS pos", "n")


def count_vaccine_cases(mart: Mart, cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(panel, label, pos, n): distinct filtered cases per label, one scan per side table."""
    cases = cases.select(fv.CASE_ID)
    parts = []
    for table in dict.fromkeys(VACCINE_PANELS[k].table for k in keys):
        cells = [f"'{k}', {VACCINE_PANELS[k].label}" for k in keys if VACCINE_PANELS[k].table == table]
        parts.append(
            mart.table(table)
            .join(cases, fv.CASE_ID, "left_semi")
            .selectExpr(fv.CASE_ID, f"stack({len(cells)}, {', '.join(cells)}) AS (panel, label)")
            .filter("label IS NOT NULL")
            .distinct()
            .groupBy("panel", "label")
            .agg(F.count("*").alias("n"))
        )
    return reduce(DataFrame.unionByName, parts).selectExpr("panel", "label", "CAST(NULL AS INT) AS pos", "n")


# --- single panels ------------------------------------------------------------


def _shape(counts: DataFrame, key: str, rate: object) -> DataFrame:
    """Rows of one panel as served: label column and scaled count, in display order."""
    panel = CASE_PANELS.get(key) or VACCINE_PANELS[key]
    by_count = isinstance(panel, VaccinePanel) or panel.by_count
    rows = counts.filter(F.col("panel") == key)
    if by_count:
        # by the raw count: scaling may make counts equal
        order = [F.desc("n"), F.asc_nulls_first("pos"), F.asc("label")]
    else:
        order = [F.asc_nulls_first("pos")]
    rows = rows.withColumn("count", derive.scaled(F.col("n"), rate))
    if isinstance(panel, CasePanel) and panel.drop_zero:
        rows = rows.filter("count > 0")
    if panel.top:
        # rank before scaling: equal scaled counts must not reorder the top labels
        rows = rows.orderBy(F.desc("n"), F.asc("label")).limit(panel.top)
    else:
        rows = rows.orderBy(*order)
    kind = panel.label_type if isinstance(panel, CasePanel) else "string"
    label = F.col("label").cast(kind)
    if key == "deaths":
        label = F.col("label").try_cast("bigint")
    return rows.select(label.alias(panel.label_name), "count")


def _single_row(counts: DataFrame, key: str, rate: object) -> DataFrame:
    def pick(label: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("label") == label, F.col("n"))), F.lit(0))

    rows = counts.filter(F.col("panel") == key)
    if key == "total":
        return rows.agg(derive.scaled(pick("total"), rate).alias("total"))
    missing, total = F.col("missing"), F.col("total")
    return rows.agg(pick("missing").alias("missing"), pick("total").alias("total")).select(
        derive.scaled(missing, rate).alias("missing"),
        derive.scaled(total, rate).alias("total"),
        derive.percent(missing, total).alias("pct"),
    )


def _finish(counts: DataFrame, key: str, rate: object) -> DataFrame:
    finish = _single_row if key in ("total", "no_vaxdate_pct") else _shape
    return finish(counts, key, rate)


def symptoms_panel(mart: Mart, spec: FilterSpec, cases: DataFrame) -> DataFrame:
    """Most reported terms; over-represented terms as soon as any condition is present."""
    if not spec.is_active:
        return top_terms(mart, spec.rate)
    return significant_terms(mart, cases, spec.rate)


def panel(mart: Mart, spec: FilterSpec, key: str, limit: int | None = None) -> DataFrame:
    """One panel as a DataFrame; of a long one only the first ``limit`` rows in its order, if asked for."""
    if limit is not None:
        return panel(mart, spec, key).limit(max(int(limit), 0))
    requested_panels([key])
    cases = selected_cases(mart, spec)
    if key == "symptoms":
        return symptoms_panel(mart, spec, cases)
    counts = count_vaccine_cases(mart, cases, [key]) if key in VACCINE_PANELS else count_cases(cases, [key])
    return _finish(counts, key, spec.rate)


def run_panels(mart: Mart, spec: FilterSpec, keys: Sequence[object] | None = None) -> dict[str, DataFrame]:
    """Several panels; all case panels read one cached count table instead of the cases."""
    wanted = requested_panels(keys)
    cases = selected_cases(mart, spec, reused=len(wanted) > 1)
    case_keys = [k for k in wanted if k in CASE_PANELS]
    vaccine_keys = [k for k in wanted if k in VACCINE_PANELS]
    counts = count_cases(cases, case_keys).cache() if case_keys else None
    vaccine_counts = count_vaccine_cases(mart, cases, vaccine_keys).cache() if vaccine_keys else None
    frames = {}
    for key in wanted:
        if key == "symptoms":
            frames[key] = symptoms_panel(mart, spec, cases)
        else:
            frames[key] = _finish(counts if key in CASE_PANELS else vaccine_counts, key, spec.rate)
    return frames


# --- whole views --------------------------------------------------------------


#: Slices of a panel's labels that are ranked side by side before the panel is.
RANKING_SLICES = 16


def _ranked(counts: DataFrame, tops: dict[str, int], rate: object) -> DataFrame:
    """Top labels of every panel at once. The window limit is applied map-side first, so a
    panel with millions of labels sends a few rows per task to the final ranking."""
    rank = F.row_number().over(
        Window.partitionBy("panel").orderBy(F.desc("n"), F.asc("label"))
    )
    largest = max(tops.values())
    ranked = counts.withColumn("rank", rank).filter(F.col("rank") <= largest)
    for key, top in tops.items():
        if top < largest:
            ranked = ranked.filter((F.col("panel") != key) | (F.col("rank") <= top))
    return ranked.select(
        "panel", F.col("rank").alias("pos"), "label", derive.scaled(F.col("n"), rate).alias("count")
    )


def _with_tops(counts: DataFrame, keys: Sequence[str], tops: dict[str, int], rate: object) -> DataFrame:
    """Panels with and without a limit from one count. A panel with a limit is cut to its top labels slice by slice,
    so that no task ranks all of its labels; the rows that are left are few in every panel."""
    slices = Window.partitionBy("panel", F.pmod(F.xxhash64("label"), F.lit(RANKING_SLICES)))
    order = [F.desc("n"), F.asc_nulls_first("pos"), F.asc("label")]
    limit = F.lit(None)
    for key, top in tops.items():
        limit = F.when(F.col("panel") == key, F.lit(top)).otherwise(limit)
    within = counts.withColumn("limit", limit).withColumn("rank", F.row_number().over(slices.orderBy(*order)))
    within = within.filter(F.col("limit").isNull() | (F.col("rank") <= F.col("limit")))
    by_count = [*tops, *(k for k in keys if CASE_PANELS[k].by_count)]
    rank = F.row_number().over(Window.partitionBy("panel").orderBy(*order))
    rows = within.withColumn("rank", rank).filter(F.col("limit").isNull() | (F.col("rank") <= F.col("limit")))
    rows = rows.withColumn("pos", F.when(F.col("panel").isin(by_count), F.col("rank")).otherwise(F.col("pos")))
    rows = rows.withColumn("count", derive.scaled(F.col("n"), rate))
    dropping = [k for k in keys if CASE_PANELS[k].drop_zero]
    return rows.filter(~F.col("panel").isin(dropping) | (F.col("count") > 0)) if dropping else rows


VIEW_COLUMNS = ["panel", "pos", "label", "count", "bg_n", "score"]


def _in_place(counts: DataFrame, keys: Sequence[str], rate: object) -> DataFrame:
    """Counts of panels without a limit; those ordered by count get their rank as position."""
    counts = counts.withColumn("count", derive.scaled(F.col("n"), rate))
    dropping = [k for k in keys if CASE_PANELS[k].drop_zero]
    if dropping:
        counts = counts.filter(~F.col("panel").isin(dropping) | (F.col("count") > 0))
    ranked = [k for k in keys if CASE_PANELS[k].by_count]
    if ranked:
        # only a few labels per panel: sex values, outcome flags, history fields, bins
        is_ranked = F.col("panel").isin(ranked)
        rank = F.row_number().over(
            Window.partitionBy("panel").orderBy(F.desc("n"), F.asc_nulls_first("pos"), F.asc("label"))
        )
        counts = counts.withColumn("pos", F.when(is_ranked, rank).otherwise(F.col("pos")))
    return counts


def view(mart: Mart, spec: FilterSpec, keys: Sequence[object] | None = None) -> DataFrame:
    """Every requested panel in one long DataFrame (panel, pos, label, count, bg_n, score).

    ``pos`` is the place within the panel for ranked panels and the natural position (bin,
    year, month) for the others; rows come in no particular order.
    """
    wanted = requested_panels(keys)
    cases = selected_cases(mart, spec, reused=len(wanted) > 1)
    complete = [k for k in wanted if k in CASE_PANELS and not CASE_PANELS[k].top]
    ranked = {k: CASE_PANELS[k].top for k in wanted if k in CASE_PANELS and CASE_PANELS[k].top}
    vaccine = {k: VACCINE_PANELS[k].top for k in wanted if k in VACCINE_PANELS}
    plain = ["panel", "CAST(pos AS INT) AS pos", "label", "count"]
    unscored = ["CAST(NULL AS BIGINT) AS bg_n", "CAST(NULL AS DOUBLE) AS score"]
    parts = []
    if complete and ranked:
        counts = count_cases(cases, [*complete, *ranked])
        parts.append(_with_tops(counts, complete, ranked, spec.rate).selectExpr(*plain, *unscored))
    elif complete:
        parts.append(_in_place(count_cases(cases, complete), complete, spec.rate).selectExpr(*plain, *unscored))
    elif ranked:
        parts.append(_ranked(count_cases(cases, list(ranked)), ranked, spec.rate).selectExpr(*plain, *unscored))
    if vaccine:
        counts = count_vaccine_cases(mart, cases, list(vaccine))
        parts.append(_ranked(counts, vaccine, spec.rate).selectExpr(*plain, *unscored))
    if "symptoms" in wanted:
        # at most TOP_LABELS rows, so ranking them is one task's work
        order = ["count DESC", "label"]
        if spec.is_active:
            order, unscored = ["score DESC", *order], ["bg_n", "score"]
            terms = symptoms_panel(mart, spec, cases).withColumnsRenamed({"symptom": "label", "fg_n": "count"})
        else:
            terms = symptoms_panel(mart, spec, cases).withColumnRenamed("symptom", "label")
        place = f"row_number() OVER (PARTITION BY panel ORDER BY {', '.join(order)}) AS pos"
        terms = terms.withColumn("panel", F.lit("symptoms"))
        parts.append(terms.selectExpr("panel", place, "label", "count", *unscored))
    return reduce(DataFrame.union, parts)


def named_view(mart: Mart, spec: FilterSpec, name: str) -> DataFrame:
    """A named panel set (its deferred panels included) on its own date axis."""
    first, deferred, axis = fv.VIEWS[name]
    return view(mart, replace(spec, date_field=axis), [*first, *deferred])


#: Panels whose rows are no parts of a whole.
WITHOUT_SHARES = ["total", "no_vaxdate_pct"]


def with_shares(shown: DataFrame) -> DataFrame:
    """Rows of a view with the ``total`` of their panel's counts and their ``share`` of it, 0 where nothing is counted.

    The total is that of the rows shown, as slices of a pie; a panel shows a bounded number of rows.
    """
    of_panel = Window.partitionBy("panel")
    rows = shown.filter(~F.col("panel").isin(WITHOUT_SHARES)).withColumn("total", F.sum("count").over(of_panel))
    share = F.when(F.col("total") > 0, F.col("count") / F.col("total")).otherwise(F.lit(0.0))
    return rows.select("panel", "pos", "label", "count", "total", share.alias("share"))
