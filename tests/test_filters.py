import datetime as dt

import pytest

from caselight.operators.drilldown import date_presets, drill
from caselight.operators.filters import Adhoc, FilterSpec, classify_field, matching_cases
from caselight import fixed_values as fv
from tests.small_mart import small_mart


def spec(**body):
    return FilterSpec.from_request(body)


def row(field, op, value):
    return spec(adhoc=[{"field": field, "op": op, "value": value}])


@pytest.fixture(scope="module")
def cases(spark, tmp_path_factory):
    subs = [
        dict(CASE_ID="0000001", SEX="F", SYMPTOM_TEXT="50% of a\\b_c", DIED="Y", AGE_YRS=1.0),
        dict(CASE_ID="0000002", SEX="", SYMPTOM_TEXT="plain", DIED="", AGE_YRS=60.0),
        dict(CASE_ID="0000003", SEX="U", HISTORY="asthma", RECOVD="N"),
        dict(CASE_ID="0000004", AGE_YRS=-1.0, IS_DOMESTIC=False),
    ]
    vax = [dict(CASE_ID="0000001", VAX_TYPE="FLU", VAX_MANU="A"), dict(CASE_ID="0000002", VAX_TYPE="HPV", VAX_MANU="B"),
           dict(CASE_ID="0000002", VAX_TYPE="FLU", VAX_MANU=None)]
    terms = [dict(CASE_ID="0000001", SYMPTOM1="Pain"), dict(CASE_ID="0000002", SYMPTOM1="PAIN", SYMPTOM2="Rash"),
             dict(CASE_ID="0000003", SYMPTOM1="Rash")]
    return small_mart(spark, tmp_path_factory.mktemp("filters"), subs, vax, terms)


def ids(mart, filter_spec):
    return sorted(int(r.CASE_ID) for r in matching_cases(mart, filter_spec).select("CASE_ID").collect())


@pytest.mark.parametrize("query, expected", [
    ("1", [1]), ("0001", [1]), ("99", []), ("9" * 25, []), ("a\\b", [1]), ("0% OF", [1]), ("P_AIN", [2]),
    ("pl_in", [2]), ("%", [1, 2]), ("*", [1, 2, 3, 4]), ("  ", [1, 2, 3, 4]),
])
def test_query(cases, query, expected):
    assert ids(cases, spec(query=query)) == expected


@pytest.mark.parametrize("field, value", [
    ("SEX", "U"), ("VAX_TYPES", "FLU"), ("HAS_DATA", "HISTORY"), ("REACTIONS", "DIED"), ("REACTIONS", "!RECOVED"),
    ("REACTIONS", "nothing"), ("SYMPTOMS", "pain"), ("SYMPTOMS", "none"), ("VAX_MANU", "A"),
])
def test_equal_and_unequal_partition_the_cases(cases, field, value):
    same, other = ids(cases, row(field, "=", value)), ids(cases, row(field, "!=", value))
    assert sorted(same + other) == [1, 2, 3, 4]


def test_terms_match_every_spelling(cases):
    assert ids(cases, row("symptoms", "=", "pAIn")) == [1, 2]


def test_unequal_on_a_plain_column_drops_missing_values(cases):
    assert ids(cases, row("DIED", "!=", "Y")) == [2]
    assert ids(cases, row("AGE_YRS", "!=", 60)) == [1, 4]


def test_ignored_rows(cases):
    for ignored in (row("AGE_YRS", ">", "old"), row("HAS_DATA", ">", "A"), row("NOPE", "=", 1), row("STATE", "=", "")):
        assert ids(cases, ignored) == [1, 2, 3, 4]
        assert not ignored.is_active


def test_unknown_term_unequal_is_a_condition(cases):
    assert row("SYMPTOMS", "!=", "none").is_active


def test_request_is_normalised():
    s = spec(query=" x ", vax_types=[" A ", "*", "All", ""], vax_type="B", date_field="recvdate",
             date_from="2020-1-5", no_vaxdate_only="true")
    assert (s.query, s.vax_types, s.date_field, s.date_from, s.no_vaxdate_only) == (
        "x", ("A", "B"), "RECVDATE", dt.date(2020, 1, 5), True)
    with pytest.raises(ValueError):
        spec(date_to="soon")
    assert spec() == FilterSpec()


def test_field_kinds():
    assert [classify_field(f) for f in ("state", "AGE_YRS", "IS_DOMESTIC", "VAX_TYPES", "REACTIONS", "SYMPTOMS",
                                        "VAX_MANU", "SYMPTOM_TEXT", None)] == [
        "str", "num", "bool", "list", "reaction", "symptom", "manu", None, None]


def test_drill_replaces_rows_on_the_same_field():
    s = drill(drill(drill(FilterSpec(), "sex", "F"), "age", "4-10"), "age", "60+")
    assert s.adhoc == (Adhoc("SEX", "=", "F"), Adhoc("AGE_YRS", ">=", 60))
    assert drill(s, "age_u20", 3).adhoc[1:] == (Adhoc("AGE_YRS", ">=", 3), Adhoc("AGE_YRS", "<", 4))


def test_date_presets():
    presets = date_presets(dt.date(2024, 2, 29))
    assert presets["Last 12 months"] == (dt.date(2023, 3, 1), dt.date(2024, 2, 29))
    assert presets["All time"] == (None, None) and len(presets) == 5


def test_every_filterable_field_has_a_kind():
    names = [*fv.STRING_FIELDS, *fv.NUMBER_FIELDS, *fv.BOOLEAN_FIELDS, *fv.LIST_FIELDS, "REACTIONS", "SYMPTOMS", "VAX_MANU"]
    assert len(names) == 24 and all(classify_field(n) for n in names)
