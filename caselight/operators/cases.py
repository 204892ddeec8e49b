"""Case-level answers: the sorted page of matching cases and the dossier of chosen cases."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselight import fixed_values as fv
from caselight.functions.derive import iso_date, onset_delay, outcome_labels
from caselight.functions.text import clean_null, first_lines
from caselight.operators.filters import FilterSpec, selected_cases
from caselight.plans.mart import Mart
from caselight.plans.model import term_lines

CASE_ID = fv.CASE_ID


@dataclass(frozen=True)
class PageSort:
    field: str = "VAX_DATE"
    descending: bool = True

    @classmethod
    def from_request(cls, field: object = None, direction: object = None) -> PageSort:
        """An unknown field resets the whole sort, direction included."""
        name = str(field or "").upper()
        if name not in fv.SORT_FIELDS:
            return cls()
        return cls(name, str(direction or "").lower() != "asc")

    def toggled(self, field: str) -> PageSort:
        """The sort after a click on a column header."""
        if field == self.field:
            return PageSort(field, not self.descending)
        return PageSort(field, True)

    @property
    def key(self) -> Column:
        return F.col(CASE_ID).try_cast("bigint") if self.field == CASE_ID else F.col(self.field)

    def columns(self) -> list[Column]:
        number = F.col(CASE_ID).try_cast("bigint")
        primary = self.key.desc_nulls_last() if self.descending else self.key.asc_nulls_last()
        return [primary] if self.field == CASE_ID else [primary, number.desc()]

    def total(self) -> list[Column]:
        """``columns`` made a total order: ids that read as the same number, or as none, go by their text."""
        return [*self.columns(), F.col(CASE_ID).asc()]


@dataclass(frozen=True)
class PageMark:
    """The last row of a page: its sort value, its id as a number (None: no number) and as text."""

    value: object
    number: int | None
    case_id: str


def _whole_number(value: object, default: int) -> int:
    try:
        return int(float(value))  # type: ignore[arg-type]
    except (TypeError, ValueError, OverflowError):
        return default


def page_limits(limit: object = None, offset: object = None) -> tuple[int, int]:
    """Clamped (limit, offset): 1..500 rows, a missing or zero limit means 50."""
    rows = _whole_number(limit, 0) or fv.PAGE_LIMIT_DEFAULT
    return min(max(rows, 1), fv.PAGE_LIMIT_MAX), max(_whole_number(offset, 0), 0)


def page_count(total: int, size: int = fv.PAGE_SIZE) -> int:
    return max(1, math.ceil(total / size))


def page_keys(
    mart: Mart, spec: FilterSpec, limit: object = None, offset: object = None, sort: PageSort = PageSort()
) -> DataFrame:
    """Ids of one page, in order: a top-k per partition over narrow columns, never a full sort."""
    rows, skip = page_limits(limit, offset)
    return (
        selected_cases(mart, spec).orderBy(*sort.columns()).offset(skip).limit(rows).select(CASE_ID)
    )


def case_page(
    mart: Mart, spec: FilterSpec, limit: object = None, offset: object = None, sort: PageSort = PageSort()
) -> DataFrame:
    """One page of matching cases.

    The page's ids (at most PAGE_LIMIT_MAX, by the clamp) are found first, without reading a
    narrative. As literals on the bucketing column they then prune the scan to the few buckets
    that hold them, so only those narratives are read.
    """
    ids = [row[0] for row in page_keys(mart, spec, limit, offset, sort).collect()]
    return _page_rows(mart, ids, sort.columns())


def _page_rows(mart: Mart, ids: list[str], order: list[Column]) -> DataFrame:
    return (
        mart.reports.filter(F.col(CASE_ID).isin(ids))
        .orderBy(*order)
        .select(
            CASE_ID,
            iso_date(F.col("VAX_DATE")).alias("VAX_DATE"),
            "AGE_YRS", "NUMDAYS", "NUM_VAX", "FOLLOWUP_COUNT",
            first_lines(F.col("SYMPTOM_TEXT")).alias("SHORT_SYMPTOM_TEXT"),
        )
    )


def _beyond(column: Column, value: object, descending: bool, later: Column) -> Column:
    """Rows after ``value`` in the order of ``column`` (nulls last), or level with it and ``later``."""
    if value is None:
        return column.isNull() & later
    literal = F.lit(value)
    past = column < literal if descending else column > literal
    # of a null the comparison is null, and nulls come last
    return F.coalesce(past | ((column == literal) & later), F.lit(True))


def after_mark(sort: PageSort, mark: PageMark) -> Column:
    """Rows that follow the marked row in the total order of ``sort``."""
    later = F.col(CASE_ID) > mark.case_id
    if sort.field != CASE_ID:
        later = _beyond(F.col(CASE_ID).try_cast("bigint"), mark.number, True, later)
    found = _beyond(sort.key, mark.value, sort.descending, later)
    if sort.field != CASE_ID and mark.value is not None:
        # implied, and free of casts: this much reaches the scan and skips row groups
        level = sort.key <= F.lit(mark.value) if sort.descending else sort.key >= F.lit(mark.value)
        found = found & (level | sort.key.isNull())
    return found


def page_mark(mart: Mart, case_id: str, sort: PageSort = PageSort()) -> PageMark:
    """The place of a case in the order of ``sort``; its id prunes the scan to one bucket."""
    row = mart.reports.filter(F.col(CASE_ID) == case_id).select(
        sort.key.alias("value"), F.col(CASE_ID).try_cast("bigint").alias("number")).first()
    if row is None:
        raise ValueError(f"no case {case_id}")
    return PageMark(row.value, row.number, case_id)


def keys_after(
    mart: Mart, spec: FilterSpec, mark: PageMark | None, limit: object = None, sort: PageSort = PageSort()
) -> DataFrame:
    """Ids of the page that follows a mark (None: the first page), in order. However deep the page, a task keeps
    only as many rows as the page has."""
    rows, _ = page_limits(limit)
    chosen = selected_cases(mart, spec)
    if mark is not None:
        chosen = chosen.filter(after_mark(sort, mark))
    return chosen.orderBy(*sort.total()).limit(rows).select(CASE_ID)


def page_after(
    mart: Mart, spec: FilterSpec, last_id: str | None = None, limit: object = None, sort: PageSort = PageSort()
) -> DataFrame:
    """The page after the one that ended with case ``last_id``; the first page without one."""
    mark = None if last_id is None else page_mark(mart, last_id, sort)
    ids = [row[0] for row in keys_after(mart, spec, mark, limit, sort).collect()]
    return _page_rows(mart, ids, sort.total())


def case_total(mart: Mart, spec: FilterSpec, size: int = fv.PAGE_SIZE) -> DataFrame:
    """Matching cases and the number of pages they fill."""
    return selected_cases(mart, spec).agg(F.count("*").alias("total")).select(
        "total", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("bigint").alias("pages")
    )


# --- dossier ------------------------------------------------------------------
# The three parts stay flat (one row per submission, vaccine or term), with the columns to
# order them by: a case with very many rows never has to fit one array or one task, and a
# dossier of all cases is not sorted as a whole. ``case_dossier`` sorts its one case.
# They read the raw rows that a model keeps by case: the id of one case prunes the scans to one bucket.


def _order() -> Column:
    return F.coalesce("REPORT_ORDER", F.lit(1)).cast("bigint").alias("REPORT_ORDER")


def _chosen(df: DataFrame, ids: Iterable[str] | DataFrame | None) -> DataFrame:
    """Rows of the chosen cases; ids are exact texts, padding included. None means all."""
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        return df.join(ids.select(CASE_ID), CASE_ID, "left_semi")
    return df.filter(F.col(CASE_ID).isin(list(ids)))


def dossier_submissions(mart: Mart, ids: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Every submission of the cases, history cleaned."""
    dates = [iso_date(F.col(d)).alias(d) for d in ("RECVDATE", "VAX_DATE", "ONSET_DATE", "DATEDIED")]
    delay = onset_delay(F.col("NUMDAYS"), F.col("VAX_DATE"), F.col("ONSET_DATE")).cast("bigint")
    return (
        _chosen(mart.table("raw_submissions"), ids)
        .select(
            CASE_ID, _order(), "FILE_LINE_NO", "IS_DOMESTIC", *dates, "AGE_YRS", "SEX", "STATE",
            delay.alias("NUMDAYS"), "V_ADMINBY", "V_FUNDBY", "SPLTTYPE", "DIED", "L_THREAT",
            "HOSPITAL", "DISABLE", "RECOVD", "ER_VISIT", "ER_ED_VISIT",
            outcome_labels().alias("OUTCOMES"), "SYMPTOM_TEXT",
            *[clean_null(F.col(f)).alias(f) for f in fv.HISTORY_FIELDS],
        )
    )


def dossier_vaccines(mart: Mart, ids: Sequence[str] | DataFrame | None = None) -> DataFrame:
    return (
        _chosen(mart.table("raw_vaccines"), ids)
        .select(
            CASE_ID, _order(), "FILE_LINE_NO", "VAX_TYPE", "VAX_NAME", "VAX_MANU", "VAX_LOT",
            "VAX_DOSE_SERIES", "VAX_ROUTE", "VAX_SITE",
        )
    )


def dossier_terms(mart: Mart, ids: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Distinct terms of each submission."""
    chosen = _chosen(mart.table("raw_terms"), ids).withColumn("REPORT_ORDER", _order())
    return term_lines(chosen, CASE_ID, "REPORT_ORDER").distinct()


def submission_entries(mart: Mart, ids: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Vaccines and terms filed under the submission with the same report order.

    One row per (submission order, kind, label) with its number of lines; entries whose order
    has no submission are not shown.
    """
    key = [CASE_ID, "REPORT_ORDER"]
    vaccines = dossier_vaccines(mart, ids).select(
        *key, F.lit("vaccine").alias("kind"), F.col("VAX_NAME").alias("label")
    )
    terms = dossier_terms(mart, ids).select(*key, F.lit("term").alias("kind"), F.col("SYMPTOM").alias("label"))
    entries = vaccines.unionByName(terms).groupBy(*key, "kind", "label").agg(F.count("*").alias("lines"))
    submissions = _chosen(mart.table("raw_submissions"), ids).select(CASE_ID, _order()).distinct()
    return entries.join(submissions, key, "left_semi")


def case_dossier(mart: Mart, case_id: str) -> dict[str, DataFrame]:
    """The dossier of one case, looked up by its exact id."""
    by_line = ["REPORT_ORDER", "FILE_LINE_NO"]
    return {
        "reports": dossier_submissions(mart, [case_id]).orderBy(*by_line),
        "vaccines": dossier_vaccines(mart, [case_id]).orderBy(*by_line),
        "symptoms": dossier_terms(mart, [case_id]).orderBy("REPORT_ORDER", "SYMPTOM"),
        "entries": submission_entries(mart, [case_id]).orderBy("REPORT_ORDER", "kind", "label"),
    }
