"""Every registered query: a name, the Spark call, and the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import oracle
from caselight import fixed_values as fv
from caselight.functions.derive import is_primary, onset_delay, outcome_labels
from caselight.functions.text import clean_null
from caselight.operators import cases, drilldown, panels, profile, signals
from caselight.operators.filters import FilterSpec, matching_cases, predicates
from caselight.plans import checks, model, refresh
from caselight.plans.mart import Mart, session_mart
from caselight.session import shared_folder, side_by_side
from caselight.sources import feed, versions
from caselight.sources.ingest import bronze_table, ingest
from caselight.sources.star_tables import raw_tables

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    build: Query
    sql: str | None


CATALOG: dict[str, Entry] = {}


def on_mart(name: str, ask: Callable[[Mart], DataFrame], sql: str | None) -> None:
    """A question to the written model of the given tables."""
    CATALOG[name] = Entry(lambda spark, folder: ask(session_mart(spark, folder)), sql)


def on_raw(name: str, ask: Callable, sql: str | None) -> None:
    """A question to the raw tables derived from the given ones."""
    CATALOG[name] = Entry(lambda spark, folder: ask(raw_tables(spark, folder)), sql)


def joined(df: DataFrame, *lists: str) -> DataFrame:
    """List columns as '::'-joined text, which both engines compare alike."""
    for name in lists:
        df = df.withColumn(name, F.array_join(name, "::"))
    return df


def rounded(df: DataFrame) -> DataFrame:
    """Scores and percentages to nine digits, where both engines agree."""
    for name in ("score", "pct"):
        if name in df.columns:
            df = df.withColumn(name, F.round(name, 9))
    return df


# --- raw tables and model ---------------------------------------------------------

# the outcome labels of a submission, in SQL
_OUTCOMES = """('::', CASE WHEN DIED = 'Y' THEN 'DIED' END,
      CASE WHEN L_THREAT = 'Y' THEN 'LIFE-THREAT' END, CASE WHEN HOSPITAL = 'Y' THEN 'HOSPITAL' END,
      CASE WHEN DISABLE = 'Y' THEN 'DISABLED' END, CASE WHEN ER_VISIT = 'Y' THEN 'ER' END,
      CASE WHEN ER_ED_VISIT = 'Y' THEN 'ER/ED' END, CASE WHEN RECOVD = 'N' THEN 'NOT RECOVERED' END)"""

on_raw("scan_submissions", lambda raw: raw.submissions, oracle.raw_sql("SELECT * FROM submissions"))
on_raw("scan_vaccines", lambda raw: raw.vaccines, oracle.raw_sql("SELECT * FROM vaccines"))
on_raw("scan_terms", lambda raw: raw.terms, oracle.raw_sql("SELECT * FROM terms"))
on_mart(
    "model_reports",
    lambda mart: joined(mart.reports, "VAX_TYPES", "HAS_DATA"),
    oracle.sql("""SELECT * REPLACE (array_to_string(VAX_TYPES, '::') AS VAX_TYPES,
      array_to_string(HAS_DATA, '::') AS HAS_DATA) FROM reports"""),
)
for _name in ("reports_vax", "symptoms", "reports_symptoms", "symptom_bg"):
    on_mart(f"model_{_name}", lambda mart, n=_name: mart.table(n), oracle.sql(f"SELECT * FROM {_name}"))
on_raw(
    "model_vaccine_rollup",
    lambda raw: joined(model.vaccine_rollup(model.vax_details(raw.vaccines)), "VAX_TYPES"),
    oracle.sql("""SELECT CASE_ID, NUM_VAX, coalesce(array_to_string(VAX_TYPES, '::'), '') AS VAX_TYPES
      FROM vax_rollup"""),
)
on_mart("model_vax_details", lambda mart: mart.vax_details,
        oracle.raw_sql("""SELECT CASE_ID, VAX_TYPE, VAX_MANU, VAX_ROUTE, VAX_SITE, VAX_DOSE_SERIES, VAX_LOT,
          count(*) AS VAX_ROWS FROM vaccines WHERE coalesce(REPORT_ORDER, 1) = 1 GROUP BY ALL"""))
on_raw(
    "model_followup_counts",
    lambda raw: model.followup_counts(raw.submissions),
    oracle.sql("SELECT * FROM followups"),
)
on_raw(
    "model_term_lines",
    lambda raw: model.term_lines(raw.terms, fv.CASE_ID),
    oracle.sql("SELECT CASE_ID, SYMPTOM FROM term_lines"),
)
on_raw(
    "function_clean_null",
    lambda raw: _cleaned_history(raw.submissions),
    oracle.raw_sql("""SELECT field, raw, cleaned, count(*) AS n FROM (""" + " UNION ALL ".join(
        f"SELECT '{f}' AS field, {f} AS raw, {oracle.cleaned(f)} AS cleaned FROM submissions"
        for f in fv.HISTORY_FIELDS) + ") GROUP BY 1, 2, 3"),
)
on_raw(
    "function_onset_delay",
    lambda raw: raw.submissions.groupBy(
        onset_delay(F.col("NUMDAYS"), F.col("VAX_DATE"), F.col("ONSET_DATE")).cast("bigint").alias("days")
    ).agg(F.count("*").alias("n")),
    oracle.raw_sql(f"SELECT {oracle.NUMDAYS} AS days, count(*) AS n FROM submissions s GROUP BY 1"),
)
on_raw(
    "function_outcome_labels",
    lambda raw: raw.submissions.groupBy(F.array_join(outcome_labels(), "::").alias("labels")).agg(
        F.count("*").alias("n")),
    oracle.raw_sql(f"""SELECT concat_ws{_OUTCOMES} AS labels,
      count(*) AS n FROM submissions GROUP BY 1"""),
)


def _cleaned_history(submissions: DataFrame) -> DataFrame:
    cells = [c for f in fv.HISTORY_FIELDS for c in (F.lit(f), F.col(f))]
    return (
        submissions.select(F.stack(F.lit(len(fv.HISTORY_FIELDS)), *cells).alias("field", "raw"))
        .groupBy("field", "raw", clean_null(F.col("raw")).alias("cleaned"))
        .agg(F.count("*").alias("n"))
    )


# --- checks -------------------------------------------------------------------------

on_mart(
    "check_model",
    checks.model_checks,
    oracle.sql("""
      SELECT 'reports_one_row_per_case' AS "check", count(*) - count(DISTINCT CASE_ID) AS violations FROM reports
      UNION ALL SELECT 'reports_symptoms_distinct', count(*) FROM
        (SELECT 1 FROM reports_symptoms GROUP BY CASE_ID, SYMPTOM_ID HAVING count(*) > 1)
      UNION ALL SELECT 'reports_vax_distinct', count(*) FROM
        (SELECT 1 FROM reports_vax GROUP BY CASE_ID, VAX_TYPE, VAX_MANU HAVING count(*) > 1)
      UNION ALL SELECT 'symptom_ids_dense', CASE WHEN count(*) > 0 AND min(SYMPTOM_ID) = 1
        AND max(SYMPTOM_ID) = count(*) THEN 0 ELSE 1 END FROM symptoms
      UNION ALL SELECT 'reports_symptoms_known_terms', count(*) FROM reports_symptoms
        WHERE SYMPTOM_ID NOT IN (SELECT SYMPTOM_ID FROM symptoms)
      UNION ALL SELECT 'reports_not_empty', CASE WHEN count(*) > 0 THEN 0 ELSE 1 END FROM reports"""),
)
on_mart(
    "check_vocabulary_size",
    lambda mart: checks.vocabulary_size(mart.symptoms),
    oracle.sql("""SELECT 'vocabulary_fits' AS "check",
      CAST(CASE WHEN count(*) > 65535 THEN 1 ELSE 0 END AS BIGINT) AS violations FROM symptoms"""),
)
on_raw(
    "check_unique_lines",
    lambda raw: reduce(DataFrame.unionByName, [
        checks.unique_lines(raw.submissions, "submissions"),
        checks.unique_lines(raw.vaccines, "vaccines"),
        checks.unique_lines(raw.terms, "terms")]),
    oracle.raw_sql(" UNION ALL ".join(
        f"""SELECT '{t}_unique_lines' AS "check", count(*) AS violations FROM
          (SELECT 1 FROM {t} GROUP BY CASE_ID, FILE_NAME, FILE_LINE_NO HAVING count(*) > 1)"""
        for t in ("submissions", "vaccines", "terms"))),
)
on_mart(
    "check_orphan_term_cases",
    lambda mart: model.term_lines(mart.raw.terms.filter(is_primary(F.col("REPORT_ORDER"))), fv.CASE_ID)
    .join(mart.reports.select(fv.CASE_ID), fv.CASE_ID, "left_anti").select(fv.CASE_ID).distinct(),
    oracle.sql("""SELECT DISTINCT CASE_ID FROM term_lines WHERE ord = 1
      AND CASE_ID NOT IN (SELECT CASE_ID FROM reports)"""),
)


# --- filters: name -> (request, the same condition in SQL on alias r) ------------------


def adhoc(field: str, op: str, value: object) -> dict:
    return {"adhoc": [{"field": field, "op": op, "value": value}]}


_SEX_U = "coalesce(nullif(SEX, ''), 'U')"
FILTERS: dict[str, tuple[dict, str]] = {
    "none": ({"query": " * "}, "TRUE"),
    "id_ignores_padding": ({"query": "42"}, "CAST(CASE_ID AS BIGINT) = 42"),
    "id_overflow": ({"query": "99999999999999999999"}, "FALSE"),
    "narrative_text": ({"query": "ERON"}, "SYMPTOM_TEXT ILIKE '%ERON%'"),
    "narrative_wildcard": ({"query": "a_e%on"}, "SYMPTOM_TEXT ILIKE '%a_e%on%'"),
    "narrative_backslash": ({"query": "\\n"}, "SYMPTOM_TEXT ILIKE '%\\n%'"),
    "vax_types_any": ({"vax_types": [" MEDIUM ", "PROMO", "*", ""]},
                      "list_has_any(VAX_TYPES, ['MEDIUM', 'PROMO'])"),
    "vax_type_legacy": ({"vax_type": "SMALL"}, "list_contains(VAX_TYPES, 'SMALL')"),
    "date_range": ({"date_from": "1996-03-01", "date_to": "1999-02-28"},
                   "VAX_DATE BETWEEN DATE '1996-03-01' AND DATE '1999-02-28'"),
    "date_axis_received": ({"date_field": "recvdate", "date_from": "1997-01-01"},
                           "RECVDATE >= DATE '1997-01-01'"),
    "date_axis_unknown": ({"date_field": "DATEDIED", "date_to": "1997-01-01"},
                          "VAX_DATE <= DATE '1997-01-01'"),
    "no_vaxdate_only": ({"no_vaxdate_only": "true"}, "VAX_DATE IS NULL"),
    "string_eq": (adhoc("state", "=", "NATION_3"), "STATE = 'NATION_3'"),
    "string_ne_drops_null": (adhoc("V_FUNDBY", "!=", "BUILDING"), "V_FUNDBY <> 'BUILDING'"),
    "string_ge": (adhoc("V_ADMINBY", ">=", "3"), "V_ADMINBY >= '3'"),
    "number_ge": (adhoc("AGE_YRS", ">=", "64.5"), "AGE_YRS >= 64.5"),
    "number_lt": (adhoc("NUMDAYS", "<", 3), "NUMDAYS < 3"),
    "number_eq": (adhoc("FOLLOWUP_COUNT", "=", "2"), "FOLLOWUP_COUNT = 2"),
    "number_ne": (adhoc("NUM_VAX", "!=", 4), "NUM_VAX <> 4"),
    "number_invalid_ignored": (adhoc("AGE_YRS", ">", "old"), "TRUE"),
    "bool_eq": (adhoc("IS_DOMESTIC", "=", "false"), "NOT IS_DOMESTIC"),
    "bool_ne": (adhoc("IS_DOMESTIC", "!=", 0), "IS_DOMESTIC"),
    "sex_u": (adhoc("SEX", "=", "U"), f"{_SEX_U} = 'U'"),
    "sex_not_u": (adhoc("SEX", "!=", "U"), f"{_SEX_U} <> 'U'"),
    "sex_not_f": (adhoc("SEX", "!=", "F"), "SEX <> 'F'"),
    "list_has": (adhoc("HAS_DATA", "=", "HISTORY"), "list_contains(HAS_DATA, 'HISTORY')"),
    "list_lacks": (adhoc("VAX_TYPES", "!=", "LARGE"), "NOT list_contains(VAX_TYPES, 'LARGE')"),
    "reaction_eq": (adhoc("REACTIONS", "=", "!RECOVED"), "RECOVD = 'N'"),
    "reaction_ne_keeps_null": (adhoc("REACTIONS", "!=", "DIED"), "DIED IS DISTINCT FROM 'Y'"),
    "reaction_unknown_eq": (adhoc("REACTIONS", "=", "toString"), "FALSE"),
    "reaction_unknown_ne": (adhoc("REACTIONS", "!=", "toString"), "TRUE"),
    "term_eq_any_case": (adhoc("SYMPTOMS", "=", "Red Widget"), oracle.has_term("red widget")),
    "term_ne": (adhoc("SYMPTOMS", "!=", "brand#4"), "NOT " + oracle.has_term("Brand#4")),
    "term_unknown_eq": (adhoc("SYMPTOMS", "=", "no such term"), "FALSE"),
    "term_unknown_ne": (adhoc("SYMPTOMS", "!=", "no such term"), "TRUE"),
    "maker_eq": (adhoc("VAX_MANU", "=", "Brand#7"), oracle.has_maker("Brand#7")),
    "maker_ne": (adhoc("VAX_MANU", "!=", "Brand#7"), "NOT " + oracle.has_maker("Brand#7")),
    "not_whitelisted": ({"adhoc": [{"field": "SYMPTOM_TEXT", "op": "=", "value": "x"},
                                   {"field": "HAS_DATA", "op": ">", "value": "A"},
                                   {"field": "STATE", "op": "LIKE", "value": "N"}]}, "TRUE"),
    "blank_rows_dropped": ({"adhoc": [{"field": "STATE", "op": "=", "value": ""},
                                      {"field": "AGE_YRS", "op": ">", "value": None}]}, "TRUE"),
    "everything": (
        {"vax_types": ["MEDIUM", "LARGE"], "date_field": "RECVDATE", "date_from": "1996-01-01",
         "adhoc": [{"field": "SEX", "op": "=", "value": "F"}, {"field": "AGE_YRS", "op": ">=", "value": 20},
                   {"field": "AGE_YRS", "op": "<", "value": 80},
                   {"field": "SYMPTOMS", "op": "!=", "value": "red widget"},
                   {"field": "VAX_MANU", "op": "!=", "value": "Brand#3"},
                   {"field": "REACTIONS", "op": "!=", "value": "HOSPITAL"}]},
        "list_has_any(VAX_TYPES, ['MEDIUM', 'LARGE']) AND RECVDATE >= DATE '1996-01-01' AND SEX = 'F' "
        f"AND AGE_YRS >= 20 AND AGE_YRS < 80 AND NOT {oracle.has_term('red widget')} "
        f"AND NOT {oracle.has_maker('Brand#3')} AND HOSPITAL IS DISTINCT FROM 'Y'"),
}


def filter_summary(mart: Mart, spec: FilterSpec) -> DataFrame:
    number = F.col(fv.CASE_ID).cast("bigint") % 1000003
    return matching_cases(mart, spec).agg(
        F.count("*").alias("cases"), F.sum(number).alias("id_sum"),
        F.min(fv.CASE_ID).alias("first_id"), F.max(fv.CASE_ID).alias("last_id"))


for _name, (_request, _where) in FILTERS.items():
    on_mart(f"filter_{_name}",
            lambda mart, r=_request: filter_summary(mart, FilterSpec.from_request(r)),
            oracle.filter_summary(_where))


# --- panels and views --------------------------------------------------------------------

NO_FILTER = FilterSpec()
SELECTION = {"vax_types": ["MEDIUM"], "date_from": "1996-01-01", "rate": 40,
             "adhoc": [{"field": "SEX", "op": "=", "value": "F"}]}
SELECTION_SQL = "list_contains(VAX_TYPES, 'MEDIUM') AND VAX_DATE >= DATE '1996-01-01' AND SEX = 'F'"
BROAD_TERM = adhoc("SYMPTOMS", "=", "Brand#2")
NO_DATE = {"no_vaxdate_only": True}

for _key in panels.PANEL_KEYS:
    on_mart(f"panel_{_key}", lambda mart, k=_key: rounded(panels.panel(mart, NO_FILTER, k)), oracle.panel(_key))
    on_mart(f"panel_{_key}_filtered",
            lambda mart, k=_key: rounded(panels.panel(mart, FilterSpec.from_request(SELECTION), k)),
            oracle.panel(_key, SELECTION_SQL, 40))
on_mart("panel_symptoms_by_term",
        lambda mart: rounded(panels.panel(mart, FilterSpec.from_request(BROAD_TERM), "symptoms")),
        oracle.panel("symptoms", oracle.has_term("Brand#2")))
on_mart("panel_symptoms_condition_always_true",
        lambda mart: rounded(panels.panel(
            mart, FilterSpec.from_request(adhoc("SYMPTOMS", "!=", "no such term")), "symptoms")),
        oracle.panel("symptoms", "TRUE OR FALSE"))
on_mart("panel_no_vaxdate_pct_nothing_selected",
        lambda mart: rounded(panels.panel(
            mart, FilterSpec.from_request(adhoc("REACTIONS", "=", "nothing")), "no_vaxdate_pct")),
        oracle.panel("no_vaxdate_pct", "FALSE"))
on_mart("panel_lag_no_date_zero_filled",
        lambda mart: panels.panel(mart, FilterSpec.from_request(NO_DATE), "lag"),
        oracle.panel("lag", "VAX_DATE IS NULL"))

for _name, (_first, _deferred, _axis) in fv.VIEWS.items():
    _id = _name.replace("-", "_")
    on_mart(f"view_{_id}", lambda mart, n=_name: rounded(panels.named_view(mart, NO_FILTER, n)),
            oracle.view([*_first, *_deferred]))
    on_mart(f"view_{_id}_filtered",
            lambda mart, n=_name: rounded(panels.named_view(mart, FilterSpec.from_request(SELECTION), n)),
            oracle.view([*_first, *_deferred], SELECTION_SQL.replace("VAX_DATE", _axis), 40))


def shares(name: str, request: dict, where: str, rate: int = 100) -> None:
    keys = ["sex", "age", "states", "vax_types", "total", "no_vaxdate_pct"]
    shown = oracle.view(keys, where, rate)
    on_mart(name,
            lambda mart: panels.with_shares(panels.view(mart, FilterSpec.from_request(request), keys)).withColumn(
                "share", F.round("share", 9)),
            f"""SELECT panel, pos, label, count, CAST(sum(count) OVER (PARTITION BY panel) AS BIGINT) AS total,
              round(CASE WHEN sum(count) OVER (PARTITION BY panel) > 0
                    THEN count / sum(count) OVER (PARTITION BY panel) ELSE 0 END, 9) AS share
              FROM ({shown}) WHERE panel NOT IN ('total', 'no_vaxdate_pct')""")


shares("shares_of_all", {}, "TRUE")
shares("shares_filtered", SELECTION, SELECTION_SQL, 40)
shares("shares_of_nothing", {"date_from": "2190-01-01"}, "VAX_DATE >= DATE '2190-01-01'")
on_mart("panel_first_ten_rows", lambda mart: panels.panel(mart, NO_FILTER, "states", 10),
        oracle.sql("SELECT STATE AS state, count(*) AS count FROM reports WHERE STATE <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))


# --- drill-down: what each slice's click selects must equal the slice -----------------------


def drilled(mart: Mart, panel: str, labels: list) -> DataFrame:
    """(label, cases) selected by clicking each label of a panel, all counted in one scan."""
    cells = []
    for label in labels:
        conditions = predicates(drilldown.drill(NO_FILTER, panel, label))
        cells += [F.lit(str(label)), F.count_if(reduce(lambda a, b: a & b, conditions))]
    counts = mart.reports.agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)])
    return counts.select(F.stack(F.lit(len(labels)), *map(F.col, counts.columns)).alias("label", "cases"))


def drilled_members(mart: Mart, panel: str, labels: list) -> DataFrame:
    """The same for labels held in a side table."""
    totals = [
        matching_cases(mart, drilldown.drill(NO_FILTER, panel, label)).agg(F.count("*").alias("cases"))
        .select(F.lit(str(label)).alias("label"), "cases")
        for label in labels
    ]
    return reduce(DataFrame.unionByName, totals)


def slices(key: str, labels: list) -> str:
    shown = ", ".join(f"'{v}'" for v in labels)
    return oracle.sql(f"SELECT CAST(label AS VARCHAR) AS label, count AS cases FROM ({oracle.long_panel(key, 100)}) "
                      f"WHERE label IN ({shown})", oracle.filtered("TRUE"))


for _key, _labels in {
    "age": list(fv.AGE_BUCKETS), "age_u20": list(fv.SINGLE_YEARS), "sex": ["F", "M", "U"],
    "reactions": list(fv.REACTIONS), "has_data": fv.HISTORY_FIELDS,
    "v_adminby": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "v_fundby": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
}.items():
    on_mart(f"drill_{_key}", lambda mart, k=_key, ls=_labels: drilled(mart, k, ls), slices(_key, _labels))
on_mart("drill_manufacturers", lambda mart: drilled_members(mart, "manufacturers", ["Brand#1", "Brand#9"]),
        oracle.sql("""SELECT VAX_MANU AS label, count(DISTINCT CASE_ID) AS cases FROM reports_vax
          WHERE VAX_MANU IN ('Brand#1', 'Brand#9') AND CASE_ID IN (SELECT CASE_ID FROM reports) GROUP BY 1"""))
on_mart("drill_states", lambda mart: drilled(mart, "states", ["NATION_1", "NATION_2", "NATION_3"]),
        oracle.sql("""SELECT STATE AS label, count(*) AS cases FROM reports
          WHERE STATE IN ('NATION_1', 'NATION_2', 'NATION_3') GROUP BY 1"""))
on_mart("drill_symptoms", lambda mart: drilled_members(mart, "symptoms", ["Brand#1", "MEDIUM"]),
        oracle.sql("""SELECT SYMPTOM AS label, bg_n AS cases FROM symptom_bg JOIN symptoms USING (SYMPTOM_ID)
          WHERE SYMPTOM IN ('Brand#1', 'MEDIUM')"""))


# --- cases --------------------------------------------------------------------------------

_PAGE = """SELECT CASE_ID, strftime(VAX_DATE, '%Y-%m-%d') AS VAX_DATE, AGE_YRS, NUMDAYS, NUM_VAX, FOLLOWUP_COUNT,
  regexp_extract(coalesce(SYMPTOM_TEXT, ''), '^(?:[^\\n]*\\n){0,9}[^\\n]*') AS SHORT_SYMPTOM_TEXT
  FROM f ORDER BY """
_TIE = "CAST(CASE_ID AS BIGINT) DESC"


def page(name: str, request: dict, where: str, order: str, limit, offset, field=None, direction=None) -> None:
    rows, skip = cases.page_limits(limit, offset)
    on_mart(f"cases_{name}",
            lambda mart: cases.case_page(
                mart, FilterSpec.from_request(request), limit, offset, cases.PageSort.from_request(field, direction)),
            oracle.sql(f"{_PAGE} {order} LIMIT {rows} OFFSET {skip}", oracle.filtered(where)))


page("first_page", {}, "TRUE", f"VAX_DATE DESC NULLS LAST, {_TIE}", 25, 0)
page("deep_page", {}, "TRUE", f"VAX_DATE DESC NULLS LAST, {_TIE}", 25, 2475)
page("by_age_ascending", SELECTION, SELECTION_SQL, f"AGE_YRS ASC NULLS LAST, {_TIE}", 100, 20, "age_yrs", "asc")
page("by_onset", {}, "TRUE", f"NUMDAYS DESC NULLS LAST, {_TIE}", 0, -5, "NUMDAYS", "desc")
page("by_id", {}, "TRUE", "CAST(CASE_ID AS BIGINT) ASC", 999, 1, "case_id", "asc")
page("unknown_sort_resets", {}, "TRUE", f"VAX_DATE DESC NULLS LAST, {_TIE}", None, None, "STATE", "asc")
page("with_narrative", {"query": "eau"}, "SYMPTOM_TEXT ILIKE '%eau%'", f"NUM_VAX DESC NULLS LAST, {_TIE}",
     500, 0, "NUM_VAX", "DESC")


def page_following(sort: cases.PageSort, order: str) -> None:
    """The third page of 40, reached from page to page by the last row shown."""
    spec = FilterSpec.from_request(SELECTION)

    def third(mart: Mart) -> DataFrame:
        last = None
        for _ in range(2):
            last = cases.keys_after(mart, spec, last and cases.page_mark(mart, last, sort), 40, sort).collect()[-1][0]
        return cases.page_after(mart, spec, last, 40, sort)

    name = f"cases_after_{sort.field.lower()}_{'down' if sort.descending else 'up'}"
    on_mart(name, third, oracle.sql(f"{_PAGE} {order}, {_TIE} LIMIT 40 OFFSET 80", oracle.filtered(SELECTION_SQL)))


for _field in fv.SORT_FIELDS:
    for _down in (True, False):
        _by = "CAST(CASE_ID AS BIGINT)" if _field == fv.CASE_ID else _field
        page_following(cases.PageSort(_field, _down), f"{_by} {'DESC' if _down else 'ASC'} NULLS LAST")

on_mart("panel_states_by_narrative", lambda mart: panels.panel(mart, FilterSpec.from_request({"query": "eau"}), "states"),
        oracle.panel("states", "SYMPTOM_TEXT ILIKE '%eau%'"))
on_mart("view_overview_by_narrative",
        lambda mart: rounded(panels.named_view(mart, FilterSpec.from_request({"query": "eau"}), "overview")),
        oracle.view(fv.VIEWS["overview"][0], "SYMPTOM_TEXT ILIKE '%eau%'"))


def searched(name: str, query: str, where: str) -> None:
    """A narrative search through the trigram index."""
    def ask(mart: Mart) -> DataFrame:
        mart.table("narrative_grams")
        return matching_cases(mart, FilterSpec(query=query)).select(fv.CASE_ID, "STATE")

    on_mart(f"search_{name}", ask, oracle.sql(f"SELECT CASE_ID, STATE FROM reports WHERE {where}"))


searched("word", "eau", "SYMPTOM_TEXT ILIKE '%eau%'")
searched("any_case", "SCHEN", "SYMPTOM_TEXT ILIKE '%schen%'")
searched("non_ascii", "ÉAU", "SYMPTOM_TEXT ILIKE '%éau%'")
searched("parts", "ung%schen", "SYMPTOM_TEXT ILIKE '%ung%schen%'")
searched("one_unknown_character", "sch_n", "SYMPTOM_TEXT ILIKE '%sch_n%'")
searched("backslash", "n\\e", "contains(SYMPTOM_TEXT, 'n' || chr(92) || 'e')")
searched("too_short_for_the_index", "q_", "SYMPTOM_TEXT ILIKE '%q_%'")
searched("nothing", "zzqqxxjj", "SYMPTOM_TEXT ILIKE '%zzqqxxjj%'")

on_mart("cases_total", lambda mart: cases.case_total(mart, FilterSpec.from_request(SELECTION)),
        oracle.sql("SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 25.0)) AS BIGINT) AS pages FROM f",
                   oracle.filtered(SELECTION_SQL)))

_ISO = ", ".join(f"strftime({d}, '%Y-%m-%d') AS {d}" for d in ("RECVDATE", "VAX_DATE", "ONSET_DATE", "DATEDIED"))
_CLEANED = ", ".join(f"{oracle.cleaned(f)} AS {f}" for f in fv.HISTORY_FIELDS)
_SUBMISSIONS_SQL = f"""SELECT CASE_ID, CAST(coalesce(REPORT_ORDER, 1) AS BIGINT) AS REPORT_ORDER, FILE_LINE_NO,
  IS_DOMESTIC, {_ISO}, AGE_YRS, SEX, STATE, {oracle.NUMDAYS} AS NUMDAYS, V_ADMINBY, V_FUNDBY, SPLTTYPE, DIED,
  L_THREAT, HOSPITAL, DISABLE, RECOVD, ER_VISIT, ER_ED_VISIT, concat_ws{_OUTCOMES} AS OUTCOMES, SYMPTOM_TEXT,
  {_CLEANED} FROM submissions s"""
on_mart("dossier_submissions", lambda mart: joined(cases.dossier_submissions(mart), "OUTCOMES"),
        oracle.raw_sql(_SUBMISSIONS_SQL))
on_mart("dossier_one_case", lambda mart: joined(cases.case_dossier(mart, "0000060")["reports"], "OUTCOMES"),
        oracle.raw_sql(_SUBMISSIONS_SQL + " WHERE CASE_ID = '0000060'"))
on_mart("dossier_unpadded_id_finds_nothing",
        lambda mart: joined(cases.case_dossier(mart, "60")["reports"], "OUTCOMES"),
        oracle.raw_sql(_SUBMISSIONS_SQL + " WHERE CASE_ID = '60'"))
on_mart("dossier_vaccines", cases.dossier_vaccines,
        oracle.raw_sql("""SELECT CASE_ID, CAST(coalesce(REPORT_ORDER, 1) AS BIGINT) AS REPORT_ORDER, FILE_LINE_NO,
          VAX_TYPE, VAX_NAME, VAX_MANU, VAX_LOT, VAX_DOSE_SERIES, VAX_ROUTE, VAX_SITE FROM vaccines"""))
on_mart("dossier_terms", cases.dossier_terms,
        oracle.sql("SELECT DISTINCT CASE_ID, CAST(ord AS BIGINT) AS REPORT_ORDER, SYMPTOM FROM term_lines"))
on_mart("dossier_entries", cases.submission_entries,
        oracle.sql("""SELECT CASE_ID, REPORT_ORDER, kind, label, count(*) AS lines FROM (
            SELECT CASE_ID, CAST(coalesce(REPORT_ORDER, 1) AS BIGINT) AS REPORT_ORDER, 'vaccine' AS kind,
              VAX_NAME AS label FROM vaccines
            UNION ALL SELECT DISTINCT CASE_ID, CAST(ord AS BIGINT), 'term', SYMPTOM FROM term_lines)
          WHERE (CASE_ID, REPORT_ORDER) IN (SELECT (CASE_ID, coalesce(REPORT_ORDER, 1)) FROM submissions)
          GROUP BY 1, 2, 3, 4"""))


# --- profile and lists ------------------------------------------------------------------------


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)


_PROFILES = _union(
    [f"""SELECT '{f}' AS field, CASE WHEN count(DISTINCT {f}) <= 200 THEN 'enum' ELSE 'text' END AS kind,
       CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, count(DISTINCT {f}) AS distinct_values
       FROM reports WHERE {f} <> ''""" for f in fv.STRING_FIELDS]
    + [f"""SELECT '{f}', 'numeric', CAST(min({f}) AS DOUBLE), CAST(max({f}) AS DOUBLE), count(DISTINCT {f})
       FROM reports""" for f in fv.NUMBER_FIELDS]
    + ["SELECT 'VAX_TYPES', 'enum', NULL, NULL, count(DISTINCT t) FROM (SELECT unnest(VAX_TYPES) AS t FROM reports)",
       "SELECT 'VAX_MANU', 'enum', NULL, NULL, count(DISTINCT VAX_MANU) FROM reports_vax WHERE VAX_MANU <> ''",
       "SELECT 'REACTIONS', 'enum', NULL, NULL, 8", "SELECT 'HAS_DATA', 'enum', NULL, NULL, 5",
       "SELECT 'IS_DOMESTIC', 'enum', NULL, NULL, 2",
       "SELECT 'SYMPTOMS', 'text', NULL, NULL, count(*) FROM symptom_bg"])
_RANK = "CAST(row_number() OVER (ORDER BY v) AS INTEGER)"
_VALUES = _union(
    [f"""SELECT '{f}' AS field, {_RANK} AS pos, v AS value FROM (SELECT DISTINCT {f} AS v FROM reports
       WHERE {f} <> '') WHERE (SELECT count(DISTINCT {f}) FROM reports WHERE {f} <> '') <= 200"""
     for f in fv.STRING_FIELDS]
    + [f"""SELECT '{f}', {_RANK}, CAST(CAST(v AS BIGINT) AS VARCHAR) FROM (SELECT DISTINCT CAST({f} AS BIGINT) AS v FROM reports
       WHERE {f} IS NOT NULL) WHERE (SELECT count(DISTINCT {f}) FROM reports) <= 20""" for f in fv.NUMBER_FIELDS]
    + [f"""SELECT 'VAX_TYPES', {_RANK}, v FROM (SELECT DISTINCT unnest(VAX_TYPES) AS v FROM reports)""",
       "SELECT DISTINCT 'VAX_MANU', CAST(NULL AS INTEGER), VAX_MANU FROM reports_vax WHERE VAX_MANU <> ''",
       """SELECT 'SYMPTOMS', CAST(row_number() OVER (ORDER BY bg_n DESC, SYMPTOM) AS INTEGER), SYMPTOM
       FROM symptom_bg JOIN symptoms USING (SYMPTOM_ID) ORDER BY bg_n DESC, SYMPTOM LIMIT 50"""]
    + [f"SELECT '{f}', {i}, '{v}'" for f, vs in (
        ("REACTIONS", fv.REACTION_CHOICES), ("HAS_DATA", fv.HISTORY_FIELDS), ("IS_DOMESTIC", ["true", "false"]))
       for i, v in enumerate(vs, 1)])
on_mart("field_profiles", profile.field_profiles, oracle.sql(_PROFILES))
on_mart("field_values", profile.field_values, oracle.sql(_VALUES))
_TYPES = "SELECT VAX_TYPE, count(DISTINCT CASE_ID) AS cases FROM reports_vax GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 500"
on_mart("list_vaccine_types", profile.vaccine_types, oracle.sql(_TYPES))
on_mart("list_vaccine_type_choices", lambda mart: profile.vaccine_type_choices(mart, " m "),
        oracle.sql("SELECT DISTINCT VAX_TYPE FROM reports_vax WHERE upper(VAX_TYPE) LIKE '%M%'"))
on_mart("status", profile.status,
        oracle.sql("SELECT (SELECT count(*) FROM reports) AS records, (SELECT count(*) FROM reports_vax) AS vax_rows"))
on_mart("top_terms_for_type", lambda mart: signals.top_terms_for_type(mart, "PROMO"),
        oracle.sql("""SELECT SYMPTOM, count(*) AS n FROM reports_symptoms JOIN symptoms USING (SYMPTOM_ID)
          WHERE CASE_ID IN (SELECT CASE_ID FROM reports_vax WHERE VAX_TYPE = 'PROMO')
          GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10"""))


# --- ingest: the raw tables written out as feed files, then loaded again -----------------------
# Files before 2000 have no ORDER column; every 77th case has an impossible RECVDATE.

_feeds: dict[tuple[str, str], str] = {}
_loads: dict[tuple, str] = {}
_SPECIAL = "".join(c for c in fv.CP1252_HIGH if c != "�")
_SPECIAL_BYTES = "".join(chr(0x80 + i) for i, c in enumerate(fv.CP1252_HIGH) if c != "�")


def _as_feed_text(df: DataFrame) -> DataFrame:
    """All columns as the texts a feed file holds."""
    def text(column: str):
        value = F.col(column)
        if column == "RECVDATE":
            broken = F.regexp_extract(fv.CASE_ID, r"(\d+)$", 1).cast("bigint") % 77 == 0
            return F.when(broken, "13/45/2020").otherwise(F.date_format(value, "MM/dd/yyyy"))
        if column in fv.DATE_COLUMNS:
            return F.date_format(value, "M/d/yyyy")
        if column == "SYMPTOM_TEXT":
            plain = F.regexp_replace(value, "[\u0080-\u009f]", "?")
            return F.translate(plain, _SPECIAL, _SPECIAL_BYTES)
        return value.cast("string")

    return df.select(*[text(c).alias(c) for c in df.columns])


def _feed_of(spark: SparkSession, folder: str) -> str:
    """Folder with one CSV folder per feed file, written once per application."""
    key = (spark.sparkContext.applicationId, folder)
    if key in _feeds:
        return _feeds[key]
    target = f"{shared_folder(spark)}/caselight/{key[0]}/feed-{uuid.uuid4().hex}"
    raw = raw_tables(spark, folder)

    def write(table: str) -> None:
        df = getattr(raw, table)
        named = df.withColumn("file", F.regexp_replace("FILE_NAME", "CSV$", "csv"))
        recent = F.col("FILE_NAME") >= "2000"
        dropped = ["IS_DOMESTIC", "FILE_NAME", "FILE_LINE_NO"]
        for rows, part in ((named.filter(recent), "recent"), (named.filter(~recent), "old")):
            rows = rows.drop(*dropped)
            rows = rows.withColumnRenamed("REPORT_ORDER", "ORDER") if part == "recent" else rows.drop("REPORT_ORDER")
            # a folder of its own for each write: of two that append to one at a time, the first to end clears the other's
            _as_feed_text(rows).write.partitionBy("file").mode("append").options(
                header="true", encoding="ISO-8859-1", escape='"',
                ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false",
            ).csv(f"{target}/{part}/{table}")

    side_by_side(spark, write, feed.TABLE_COLUMNS)
    _feeds[key] = target
    return target


def _bronze_of(spark: SparkSession, folder: str, block_bytes: int | None = None, twice: bool = False) -> str:
    """The bronze tables of the feed, read in blocks of a given size if one is asked for."""
    key = (spark.sparkContext.applicationId, folder, block_bytes, twice)
    if key not in _loads:
        source = _feed_of(spark, folder)
        bronze = f"{source}-bronze-{uuid.uuid4().hex}"
        ingest(spark, source, bronze, block_bytes=block_bytes)
        if twice:
            # the recent files come in again: they replace themselves, the old ones stay
            ingest(spark, f"{source}/recent", bronze, append=True)
        _loads[key] = bronze
    return _loads[key]


def on_bronze(name: str, ask: Callable[[SparkSession, str], DataFrame], sql: str, **how) -> None:
    CATALOG[name] = Entry(lambda spark, folder: ask(spark, _bronze_of(spark, folder, **how)), sql)


def _bronze(table: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, bronze: bronze_table(spark, bronze, table).drop("FILE_LINE_NO")


_KEY_NUMBER = "CAST(regexp_extract(CASE_ID, '[0-9]+$') AS BIGINT)"
_LOADED_ORDER = "CASE WHEN FILE_NAME >= '2000' THEN coalesce(REPORT_ORDER, 1) ELSE 1 END AS REPORT_ORDER"
_LOADED_TEXT = ("regexp_replace(nullif(regexp_replace(SYMPTOM_TEXT, '\\r\\n?', chr(10), 'g'), ''), "
                f"'[^\\x{{01}}-\\x{{7f}}\\x{{a0}}-\\x{{ff}}{_SPECIAL}]', '?', 'g') AS SYMPTOM_TEXT")


def _loaded(table: str, columns: list[str]) -> str:
    """The raw table as it reads after the trip through feed files."""
    changed = {"REPORT_ORDER": _LOADED_ORDER, "SYMPTOM_TEXT": _LOADED_TEXT,
               "RECVDATE": f"CASE WHEN {_KEY_NUMBER} % 77 <> 0 THEN RECVDATE END AS RECVDATE"}
    typed = {*fv.DATE_COLUMNS, *fv.DOUBLE_COLUMNS, *fv.INTEGER_COLUMNS, "CASE_ID", "FILE_NAME", "IS_DOMESTIC"}
    shown = [changed.get(c) or (c if c in typed else f"nullif({c}, '') AS {c}")
             for c in [*columns, "REPORT_ORDER", "IS_DOMESTIC", "FILE_NAME"]]
    return oracle.raw_sql(f"SELECT {', '.join(shown)} FROM {table}")


for _table, _columns in feed.TABLE_COLUMNS.items():
    on_bronze(f"ingest_{_table}", _bronze(_table), _loaded(_table, _columns))
    on_bronze(f"ingest_{_table}_in_blocks", _bronze(_table), _loaded(_table, _columns), block_bytes=1 << 16)
on_bronze("ingest_replace_by_file", _bronze("submissions"), _loaded("submissions", fv.SUBMISSION_COLUMNS), twice=True)


def _after_a_failed_run(spark: SparkSession, bronze: str) -> DataFrame:
    """The submissions after a run that wrote all its rows and then found repeated keys."""
    base = versions.latest(spark, bronze)
    rows = bronze_table(spark, bronze, "submissions")
    again = rows.unionByName(rows.where("FILE_NAME >= '2000'")).withColumn("run", F.lit(f"failed-{uuid.uuid4().hex}"))
    again.write.mode("append").partitionBy("run", "FILE_NAME").parquet(f"{bronze}/submissions")
    if versions.latest(spark, bronze) != base:
        raise RuntimeError("rows that no run published are read")
    return bronze_table(spark, bronze, "submissions").drop("FILE_LINE_NO")


on_bronze("ingest_after_failed_run", _after_a_failed_run, _loaded("submissions", fv.SUBMISSION_COLUMNS))
on_bronze("ingest_old_version", lambda spark, bronze: bronze_table(spark, bronze, "submissions", 1).drop("FILE_LINE_NO"),
          _loaded("submissions", fv.SUBMISSION_COLUMNS), twice=True)
on_bronze(
    "ingest_manifest",
    lambda spark, bronze: versions.manifest(spark, bronze, versions.latest(spark, bronze)).select(
        "table_name", "file_name", "rows"),
    oracle.raw_sql(" UNION ALL ".join(
        f"SELECT '{t}' AS table_name, FILE_NAME AS file_name, count(*) AS rows FROM {t} GROUP BY 2" for t in feed.TABLE_COLUMNS)),
    twice=True)
on_bronze(
    "ingest_altered_files",
    lambda spark, bronze: versions.altered_files(spark, bronze, versions.latest(spark, bronze)),
    "SELECT 'x' AS table_name, 'x' AS file_name, CAST(0 AS BIGINT) AS rows_told, CAST(0 AS BIGINT) AS rows_found WHERE 1 = 0",
    twice=True)
on_bronze(
    "ingest_key_gate_passes",
    lambda spark, bronze: versions.file_keys(bronze_table(spark, bronze, "submissions"), "submissions", "r").select(
        "file_name", "rows", "repeated"),
    oracle.raw_sql("SELECT FILE_NAME AS file_name, count(*) AS rows, CAST(0 AS BIGINT) AS repeated FROM submissions GROUP BY 1"))


def _with_repeats(spark: SparkSession, bronze: str) -> DataFrame:
    rows = bronze_table(spark, bronze, "submissions")
    again = rows.where(F.regexp_extract(fv.CASE_ID, r"(\d+)$", 1).cast("bigint") % 97 == 0)
    return versions.file_keys(rows.unionByName(again), "submissions", "r").select("file_name", "rows", "repeated")


on_bronze(
    "ingest_key_gate_fails", _with_repeats,
    oracle.raw_sql(f"""SELECT FILE_NAME AS file_name, count(*) + count_if({_KEY_NUMBER} % 97 = 0) AS rows,
      count_if({_KEY_NUMBER} % 97 = 0) AS repeated FROM submissions GROUP BY 1"""))
on_bronze(
    "ingest_line_numbers",
    lambda spark, bronze: bronze_table(spark, bronze, "submissions").groupBy("FILE_NAME").agg(
        F.count("*").alias("n"), F.min("FILE_LINE_NO").cast("bigint").alias("first_line"),
        F.max("FILE_LINE_NO").cast("bigint").alias("last_line"), F.count_distinct("FILE_LINE_NO").alias("lines")),
    oracle.raw_sql("""SELECT FILE_NAME, count(*) AS n, CAST(1 AS BIGINT) AS first_line, count(*) AS last_line,
      count(*) AS lines FROM submissions GROUP BY 1"""),
    block_bytes=1 << 16)
on_bronze(
    "ingest_summary",
    lambda spark, bronze: spark.read.parquet(f"{bronze}/import_summary").drop("logged_at"),
    oracle.raw_sql(" UNION ALL ".join(
        f"""SELECT FILE_NAME AS file_name, '{t}' AS table_name, count(*) AS rows_imported,
          CAST(0 AS BIGINT) AS rows_rejected FROM {t} GROUP BY 1""" for t in feed.TABLE_COLUMNS)))
on_bronze(
    "ingest_unparseable",
    lambda spark, bronze: spark.read.parquet(f"{bronze}/unparseable").drop("logged_at"),
    oracle.raw_sql(f"""SELECT FILE_NAME, 'RECVDATE' AS "column", count(*) AS bad, 'submissions' AS table_name
      FROM submissions WHERE {_KEY_NUMBER} % 77 = 0 GROUP BY 1"""))


# --- refresh: a model of most cases, then brought up to a version that holds all ---------------
# One file of the first version holds cases that are gone in the second, which brings others instead.

_refreshed: dict[tuple[str, str], Mart] = {}
_GONE = "GONE"


def _refreshed_mart(spark: SparkSession, folder: str) -> Mart:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _refreshed:
        raw = raw_tables(spark, folder)
        target = f"{shared_folder(spark)}/caselight/{key[0]}/refresh-{uuid.uuid4().hex}"
        rest = F.regexp_extract(fv.CASE_ID, r"(\d+)$", 1).cast("bigint") % 4001
        line = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(2**31 - 1)).cast("int")
        # cases are chosen before the lines are numbered, so that only they are derived
        chosen = lambda cases: {t: getattr(raw, t).where(cases).withColumn("FILE_LINE_NO", line) for t in feed.TABLE_COLUMNS}
        others = chosen(~rest.isin(1, 2))
        moved = lambda df: df.withColumn("FILE_NAME", F.lit("1990MOVED.CSV"))
        gone = {t: moved(df.where(rest == 3)).withColumn(fv.CASE_ID, F.concat(F.lit(_GONE), fv.CASE_ID)) for t, df in chosen(rest == 3).items()}
        gone["terms"] = gone["terms"].withColumn("SYMPTOM1", F.lit(" a term of gone cases "))
        versions.add_tables(spark, target, {t: df.unionByName(gone[t]) for t, df in others.items()})
        refresh.build_from_bronze(spark, target, f"{target}/model", 64)
        versions.add_tables(spark, target, {t: moved(df) for t, df in chosen(rest.isin(1, 2)).items()})
        _refreshed[key] = refresh.refresh_model(spark, target, f"{target}/model").mart
    return _refreshed[key]


def on_refreshed(name: str, ask: Callable[[Mart], DataFrame], sql: str) -> None:
    CATALOG[f"refresh_{name}"] = Entry(lambda spark, folder: ask(_refreshed_mart(spark, folder)), sql)


on_refreshed("reports", lambda mart: joined(mart.reports, "VAX_TYPES", "HAS_DATA"), CATALOG["model_reports"].sql)
for _name in ("reports_vax", "symptoms", "reports_symptoms", "symptom_bg", "vax_details"):
    on_refreshed(_name, lambda mart, n=_name: mart.table(n), CATALOG[f"model_{_name}"].sql)
on_refreshed("checks", checks.model_checks, CATALOG["check_model"].sql)
on_refreshed("dossier_vaccines", lambda mart: cases.dossier_vaccines(mart).drop("FILE_LINE_NO"),
             oracle.raw_sql("""SELECT CASE_ID, CAST(coalesce(REPORT_ORDER, 1) AS BIGINT) AS REPORT_ORDER, VAX_TYPE, VAX_NAME,
               VAX_MANU, VAX_LOT, VAX_DOSE_SERIES, VAX_ROUTE, VAX_SITE FROM vaccines"""))
on_refreshed("term_cases", lambda mart: matching_cases(mart, FilterSpec.from_request(
    {"adhoc": [{"field": "SYMPTOMS", "op": "=", "value": "medium"}]})).select(fv.CASE_ID),
    oracle.sql("""SELECT CASE_ID FROM reports WHERE CASE_ID IN (SELECT CASE_ID FROM reports_symptoms JOIN symptoms
      USING (SYMPTOM_ID) WHERE lower(SYMPTOM) = 'medium')"""))
on_refreshed("search", lambda mart: matching_cases(mart, FilterSpec(query="schen")).select(fv.CASE_ID),
             oracle.sql("SELECT CASE_ID FROM reports WHERE SYMPTOM_TEXT ILIKE '%schen%'"))
