import pytest

from caselight import fixed_values as fv
from caselight.operators import panels, profile, signals
from caselight.operators.cases import (
    PageSort, case_dossier, case_page, page_count, page_limits, submission_entries,
)
from caselight.operators.drilldown import drill
from caselight.operators.filters import FilterSpec, matching_cases
from caselight.operators.panels import PANEL_KEYS, PanelError, panel, requested_panels, run_panels, view
from tests.small_mart import small_mart


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_registry_is_complete():
    assert len(PANEL_KEYS) == 28
    for first, deferred, _ in fv.VIEWS.values():
        assert set(first + deferred) <= set(PANEL_KEYS)


@pytest.mark.parametrize("bad", [[], ["nope"], "total", ["total"] * 41])
def test_bad_requests(bad):
    with pytest.raises(PanelError):
        requested_panels(bad)


def test_requests():
    assert requested_panels(None) == fv.VIEWS["overview"][0]
    assert requested_panels(["total", "sex", "total"]) == ["total", "sex"]


@pytest.mark.parametrize("key", ["age", "lag", "followup_dist", "onset_days", "num_vax", "age_u20"])
def test_bins_are_zero_filled_in_order(mart, key):
    nothing = FilterSpec.from_request({"adhoc": [{"field": "REACTIONS", "op": "=", "value": "none"}]})
    domain = [str(d) for d in panels.CASE_PANELS[key].domain]
    found = rows(panel(mart, nothing, key))
    assert [str(label) for label, _ in found] == domain and {n for _, n in found} == {0}


def test_bins_and_the_rest_add_up(mart):
    total = panel(mart, FilterSpec(), "total").first().total
    counted = sum(n for _, n in rows(panel(mart, FilterSpec(), "age")))
    missing = mart.reports.filter("AGE_YRS IS NULL OR AGE_YRS < 0").count()
    assert counted + missing == total == mart.reports.count()


@pytest.mark.parametrize("key", ["age", "sex", "states", "has_data", "reactions", "v_adminby", "manufacturers"])
def test_clicking_a_slice_selects_it(mart, key):
    for label, n in rows(panel(mart, FilterSpec(), key))[:3]:
        assert matching_cases(mart, drill(FilterSpec(), key, label)).count() == n


def test_many_panels_equal_single_ones(mart):
    spec = FilterSpec.from_request({"vax_types": ["MEDIUM"], "rate": 30})
    for key, df in run_panels(mart, spec, PANEL_KEYS).items():
        assert rows(df) == rows(panel(mart, spec, key)), key


def test_view_ranks_follow_the_panels(mart):
    spec = FilterSpec.from_request({"adhoc": [{"field": "SEX", "op": "=", "value": "F"}]})
    found = {}
    for r in view(mart, spec, ["states", "sex", "vax_types", "symptoms"]).orderBy("panel", "pos").collect():
        found.setdefault(r.panel, []).append(r.label)
    for key, labels in found.items():
        assert labels == [r[0] for r in rows(panel(mart, spec, key))], key


def counted_terms(spark, folder, fg, bg, total):
    """``bg`` of ``total`` cases have the term; ``fg`` of them, and no other case, are women."""
    subs = [dict(CASE_ID=str(i), SEX="F" if i < fg else "M") for i in range(total)]
    return small_mart(spark, folder, subs, [], [dict(CASE_ID=str(i), SYMPTOM1="Pain") for i in range(bg)])


@pytest.mark.parametrize("fg, bg, shown", [(5, 25, True), (4, 25, False), (5, 24, False)])
def test_significance_thresholds(spark, tmp_path, fg, bg, shown):
    mart = counted_terms(spark, tmp_path, fg, bg, 50)
    women = matching_cases(mart, FilterSpec.from_request({"adhoc": [{"field": "SEX", "op": "=", "value": "F"}]}))
    found = rows(signals.significant_terms(mart, women))
    assert bool(found) == shown
    if shown:
        fg_share, bg_share = 1.0, 25 / 50
        assert found == [("Pain", 5, 25, (fg_share - bg_share) * (fg_share / bg_share))]


def test_a_condition_that_always_holds_shows_no_terms(mart):
    spec = FilterSpec.from_request({"adhoc": [{"field": "REACTIONS", "op": "!=", "value": "none"}]})
    assert rows(panel(mart, spec, "symptoms")) == []
    assert len(rows(panel(mart, FilterSpec(), "symptoms"))) == 15


def test_page_rules():
    assert page_limits() == (50, 0)
    assert page_limits(0, -1) == (50, 0)
    assert page_limits("700", "30") == (500, 30)
    assert page_limits(-2, "x") == (1, 0)
    assert (page_count(0), page_count(25), page_count(26)) == (1, 1, 2)
    assert PageSort.from_request("nope", "asc") == PageSort("VAX_DATE", True)
    assert PageSort.from_request("age_yrs", "ASC") == PageSort("AGE_YRS", False)
    assert PageSort("AGE_YRS", True).toggled("AGE_YRS") == PageSort("AGE_YRS", False)
    assert PageSort("AGE_YRS", False).toggled("NUM_VAX") == PageSort("NUM_VAX", True)


def test_pages_tile_the_cases(mart):
    seen = []
    for offset in range(0, 1500, 500):
        seen += [r.CASE_ID for r in case_page(mart, FilterSpec(), 500, offset).collect()]
    assert len(seen) == len(set(seen)) == mart.reports.count()


def test_dossier(spark, tmp_path):
    subs = [dict(CASE_ID="1", REPORT_ORDER=2, HISTORY="none", FILE_LINE_NO=1), dict(CASE_ID="1", HISTORY="asthma")]
    vax = [dict(CASE_ID="1", VAX_NAME="V", REPORT_ORDER=2), dict(CASE_ID="1", VAX_NAME="V", REPORT_ORDER=2),
           dict(CASE_ID="1", VAX_NAME="W", REPORT_ORDER=7)]
    terms = [dict(CASE_ID="1", SYMPTOM1="b", SYMPTOM2=" a "), dict(CASE_ID="1", SYMPTOM1="a")]
    mart = small_mart(spark, tmp_path, subs, vax, terms)
    dossier = case_dossier(mart, "1")
    assert [(r.REPORT_ORDER, r.HISTORY) for r in dossier["reports"].collect()] == [(1, "asthma"), (2, None)]
    assert [r.SYMPTOM for r in dossier["symptoms"].collect()] == ["a", "b"]
    assert dossier["vaccines"].count() == 3
    assert sorted(rows(submission_entries(mart))) == [("1", 1, "term", "a", 1), ("1", 1, "term", "b", 1), ("1", 2, "vaccine", "V", 2)]
    assert case_dossier(mart, "01")["reports"].isEmpty()


def test_profile_of_one_field(mart):
    summary, values = profile.describe_field(mart, "followup_count")
    assert summary.first().kind == "numeric"
    assert [r.value for r in values.orderBy("pos").collect()] == ["0", "1", "2"]
    with pytest.raises(ValueError):
        profile.describe_field(mart, "SYMPTOM_TEXT")


def test_many_text_values_are_not_listed(spark, tmp_path):
    mart = small_mart(spark, tmp_path, [dict(CASE_ID=str(i), STATE=f"S{i}") for i in range(201)])
    summary, values = profile.describe_field(mart, "STATE")
    assert (summary.first().kind, summary.first().distinct_values) == ("text", 201)
    assert values.isEmpty()
