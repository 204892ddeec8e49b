"""Pages by their last row, narrative search by trigrams, ids by ranges, shares."""

import datetime as dt
import random

import pytest
from tests.small_mart import small_mart

from caselight import fixed_values as fv
from caselight.operators import cases, panels
from caselight.operators.filters import FilterSpec, buckets_to_search, matching_cases, search_grams
from caselight.plans import model
from caselight.plans.mart import build_model, open_model

EVERY = FilterSpec()


@pytest.fixture(scope="module")
def odd_mart(spark, tmp_path_factory):
    """Ids that are no numbers or the same number, many nulls and ties."""
    r = random.Random(4)
    ids = [*(f"{i:07d}" for i in range(40)), "7", "07", "x", "y1", "12a"]
    rows = [{"CASE_ID": c, "REPORT_ORDER": 1, "AGE_YRS": r.choice([None, 1.0, 2.5, float("nan")]),
             "VAX_DATE": r.choice([None, dt.date(2020, 1, 1), dt.date(2021, 5, 5)]), "NUMDAYS": r.choice([None, 3, 4])} for c in ids]
    return small_mart(spark, tmp_path_factory.mktemp("odd"), rows, [{"CASE_ID": "x", "REPORT_ORDER": 1, "VAX_TYPE": "A"}], [])


@pytest.mark.parametrize("field", fv.SORT_FIELDS)
@pytest.mark.parametrize("down", [True, False])
def test_walking_all_pages_is_the_full_sort(odd_mart, field, down):
    sort = cases.PageSort(field, down)
    whole = [r[0] for r in odd_mart.reports.orderBy(*sort.total()).select("CASE_ID").collect()]
    walked, last = [], None
    while True:
        mark = None if last is None else cases.page_mark(odd_mart, last, sort)
        ids = [r[0] for r in cases.keys_after(odd_mart, EVERY, mark, 14, sort).collect()]
        if not ids:
            break
        assert len(ids) <= 14
        walked, last = walked + ids, ids[-1]
    assert walked == whole
    assert [r.CASE_ID for r in cases.page_after(odd_mart, EVERY, whole[13], 14, sort).collect()] == whole[14:28]


def test_a_deep_page_keeps_only_its_rows(mart):
    sort = cases.PageSort("VAX_DATE", True)
    mark = cases.page_mark(mart, mart.reports.filter("VAX_DATE < '1996-01-01'").first().CASE_ID, sort)
    text = cases.keys_after(mart, EVERY, mark, 25, sort)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=25" in text and "LessThanOrEqual(VAX_DATE" in text and "SYMPTOM_TEXT" not in text
    with pytest.raises(ValueError, match="no case"):
        cases.page_mark(mart, "nobody")


def test_grams_of_literal_parts():
    assert search_grams("abcd%xy_é𝒜b") == ["abc", "é𝒜b", "bcd"]
    assert search_grams("ab%cd") == [] and search_grams("") == [] and len(search_grams("".join(map(chr, range(97, 297))))) == 64


TEXTS = ["Plain fever", "FEVER and pain", "naïve ÉCLAIR", r"back\slash", "100% sure", "under_score", "a\nb\nc", "𝒜𝒜𝒜𝒜", "x", None, "İstanbul"]


@pytest.mark.parametrize("query", ["fever", "FEVER", "éclair", r"k\s", "0% s", "fev%pain", "r_s", "a\nb", "𝒜𝒜𝒜", "zz", "sure%100", "nul", "istanbul", "i̇st"])
def test_indexed_search_equals_the_scan(spark, tmp_path_factory, query):
    rows = [{"CASE_ID": str(i), "REPORT_ORDER": 1, "SYMPTOM_TEXT": t} for i, t in enumerate(TEXTS)]
    plain = _search_mart(spark, tmp_path_factory, rows, False)
    indexed = _search_mart(spark, tmp_path_factory, rows, True)
    found = [sorted(r.CASE_ID for r in matching_cases(m, FilterSpec(query=query)).collect()) for m in (plain, indexed)]
    assert found[0] == found[1]


_marts = {}


def _search_mart(spark, factory, rows, indexed):
    if indexed not in _marts:
        _marts[indexed] = small_mart(spark, factory.mktemp("search"), rows, buckets=8)
        if indexed:
            _marts[indexed].table("narrative_grams")
    return _marts[indexed]


def test_a_rare_search_reads_few_buckets(spark, tmp_path_factory):
    rows = [{"CASE_ID": str(i), "REPORT_ORDER": 1, "SYMPTOM_TEXT": t} for i, t in enumerate(TEXTS)]
    mart = _search_mart(spark, tmp_path_factory, rows, True)
    assert len(buckets_to_search(mart, "éclair")) == 1 and buckets_to_search(mart, "q%") is None
    assert buckets_to_search(mart, "no such words") == []
    files = matching_cases(mart, FilterSpec(query="éclair"))
    files.collect()
    text = files._jdf.queryExecution().executedPlan().toString()
    assert "file_name" in text and buckets_to_search(_search_mart(spark, tmp_path_factory, rows, False), "éclair") is None


@pytest.mark.parametrize("cuts", [1, 7, 255, 10_000])
def test_ids_do_not_depend_on_the_cuts(spark, cuts):
    words = [f"{a}{b}é" for a in "qwertzuiop" for b in range(60)]
    random.Random(cuts).shuffle(words)
    found = model.symptoms(spark.createDataFrame([(w,) for w in words], "SYMPTOM string"), cuts).collect()
    assert sorted((r.SYMPTOM_ID, r.SYMPTOM) for r in found) == list(enumerate(sorted(words), 1))


def test_ranges_stay_small(spark, monkeypatch):
    monkeypatch.setattr(model, "RANGE_TERMS", 50)
    words = spark.range(2000).selectExpr("concat('t', id) AS SYMPTOM")
    plan = model.symptoms(words)
    sizes = plan.selectExpr("SYMPTOM_ID").count()
    assert sizes == 2000


def test_shares_add_up(mart):
    rows = panels.with_shares(panels.view(mart, EVERY, ["sex", "no_vaxdate_pct", "states"])).collect()
    assert {r.panel for r in rows} == {"sex", "states"}
    assert sum(r.share for r in rows if r.panel == "sex") == pytest.approx(1)
    empty = FilterSpec(date_from=dt.date(2190, 1, 1))
    assert {r.share for r in panels.with_shares(panels.view(mart, empty, ["age"])).collect()} == {0.0}


def test_a_published_model_searches_by_its_index(mart, tmp_path):
    build_model(mart.raw, mart.spark, str(tmp_path))
    served = open_model(mart.spark, str(tmp_path))
    assert served.holds("narrative_grams") and buckets_to_search(served, "zzqqxxjj") == []
    assert matching_cases(served, FilterSpec(query="zzqqxxjj")).count() == 0
    assert matching_cases(served, FilterSpec(query="eau")).count() == matching_cases(mart, FilterSpec(query="eau")).count()
