"""The physical plans a cluster would run."""

import pytest

from caselight.operators import cases, panels, signals
from caselight.operators.filters import FilterSpec, matching_cases

TERM = {"adhoc": [{"field": "SYMPTOMS", "op": "=", "value": "red widget"}]}


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


def adhoc(field, op, value):
    return FilterSpec.from_request({"adhoc": [{"field": field, "op": op, "value": value}]})


@pytest.mark.parametrize("field, op, join", [
    ("SYMPTOMS", "=", "LeftSemi"), ("SYMPTOMS", "!=", "LeftAnti"), ("VAX_MANU", "=", "LeftSemi"), ("VAX_MANU", "!=", "LeftAnti"),
])
def test_side_tables_meet_cases_by_semi_or_anti_join(mart, field, op, join):
    assert join in plan(matching_cases(mart, adhoc(field, op, "red widget")))


def test_filters_reach_the_scan_and_columns_are_pruned(mart):
    spec = FilterSpec.from_request({"date_from": "1996-01-01", "adhoc": [{"field": "NUM_VAX", "op": ">=", "value": 3}]})
    text = plan(panels.panel(mart, spec, "sex"))
    assert "GreaterThanOrEqual(VAX_DATE,1996-01-01)" in text and "GreaterThanOrEqual(NUM_VAX,3)" in text
    schema = text.split("ReadSchema: ")[1].split("\n")[0]
    assert schema == "struct<VAX_DATE:date,SEX:string,NUM_VAX:bigint>"


@pytest.mark.parametrize("key", panels.PANEL_KEYS)
def test_panels_stay_in_the_jvm_and_cross_nothing(mart, key):
    text = plan(panels.panel(mart, FilterSpec.from_request(TERM), key))
    for unwanted in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in text


@pytest.mark.parametrize("key", ["states", "vax_combos", "vax_lot", "manufacturers"])
def test_top_labels_never_sort_everything(mart, key):
    assert "TakeOrderedAndProject" in plan(panels.panel(mart, FilterSpec(), key))


def test_case_page_is_a_narrow_top_k(mart):
    text = plan(cases.page_keys(mart, FilterSpec(), 25, 100))
    assert "TakeOrderedAndProject" in text and "SYMPTOM_TEXT" not in text


def test_case_page_reads_only_the_buckets_of_its_cases(mart):
    # buckets are pruned either way; only a scan planned as bucketed says so
    mart.spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        text = plan(cases.case_page(mart, FilterSpec(), 1, 0))
    finally:
        mart.spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert f"SelectedBucketsCount: 1 out of {mart.store.buckets}" in text


def test_narratives_are_searched_once(mart):
    spec = FilterSpec.from_request({"query": "eau"})
    assert "SYMPTOM_TEXT" not in plan(panels.named_view(mart, spec, "people"))


def test_another_session_sees_the_bucketing(mart, tmp_path):
    from caselight.plans.mart import build_model, open_model

    build_model(mart.raw, mart.spark, str(tmp_path))
    other = open_model(mart.spark.newSession(), str(tmp_path))
    other.spark.sql("DROP TABLE " + other.store._catalog_name("reports"))
    other._tables.clear()
    text = plan(other.reports.groupBy("CASE_ID").count())
    assert "Exchange" not in text and "Bucketed: true" in text
    assert other.reports.count() == mart.reports.count()


def test_vaccine_panel_exchanges_only_its_counts(mart):
    """Scan, semi join and per-case distinct run bucket by bucket."""
    counts = panels.count_vaccine_cases(mart, mart.reports, ["vax_types", "manufacturers"])
    mart.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(panels.count_vaccine_cases(mart, mart.reports, ["vax_types", "manufacturers"]))
    finally:
        mart.spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 1
    assert counts.columns == ["panel", "label", "pos", "n"]


def test_many_case_panels_share_one_scan(mart):
    text = plan(panels.count_cases(mart.reports, list(panels.CASE_PANELS)))
    assert text.count("FileScan parquet") == 1 and text.count("Exchange hashpartitioning") == 1


def test_significant_terms_shuffle_counts_only(mart):
    mart.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(signals.significant_terms(mart, matching_cases(mart, adhoc("SEX", "=", "F"))))
    finally:
        mart.spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(CASE_ID" not in text


def test_a_view_scans_the_cases_once_for_all_case_panels(mart):
    keys = [k for k in panels.PANEL_KEYS if k in panels.CASE_PANELS]
    text = plan(panels.view(mart, FilterSpec.from_request({"date_from": "1996-01-01"}), keys))
    assert text.count("FileScan parquet") == 1
