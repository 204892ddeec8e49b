import pytest
from pyspark.sql import functions as F

from caselight.plans import checks, model
from tests.small_mart import frame, small_mart


def violations(df):
    return df.first().violations


def test_dense_ids_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(model, "RANGE_TERMS", 48)
    words = sorted({f"{a}{b}" for a in "aAzé €" for b in range(40)}, key=lambda w: w.encode())
    df = spark.createDataFrame([(w,) for w in reversed(words)], "SYMPTOM string")
    found = [(r.SYMPTOM_ID, r.SYMPTOM) for r in model.symptoms(df).orderBy("SYMPTOM_ID").collect()]
    assert found == list(enumerate(words, 1))


def test_salted_dictionary_join_equals_the_broadcast_one(spark, mart):
    raw = mart.raw
    args = (raw.terms, mart.symptoms, mart.reports)
    small = model.reports_symptoms(*args, small_dictionary=True)
    salted = model.reports_symptoms(*args, small_dictionary=False)
    assert small.exceptAll(salted).isEmpty() and salted.exceptAll(small).isEmpty()
    assert "salt" in salted._jdf.queryExecution().executedPlan().toString()


def test_hot_case_and_hot_term(spark, tmp_path):
    """A third of all raw rows belong to one case, and one term is everywhere."""
    many = [dict(CASE_ID="0000001", VAX_TYPE="FLU", VAX_MANU="A", VAX_LOT=str(i % 3)) for i in range(300)]
    few = [dict(CASE_ID=f"{i:07d}", VAX_TYPE="FLU", VAX_MANU="B") for i in range(2, 602)]
    mart = small_mart(
        spark, tmp_path,
        [dict(CASE_ID=f"{i:07d}") for i in range(1, 602)]
        + [dict(CASE_ID="0000001", REPORT_ORDER=2 + i) for i in range(300)],
        many + few,
        [dict(CASE_ID=v["CASE_ID"], SYMPTOM1=" Pain ", SYMPTOM2="Pain") for v in many + few],
    )
    assert mart.reports_vax.count() == 601
    assert mart.vax_details.count() == 603 and mart.vax_details.groupBy().sum("VAX_ROWS").first()[0] == 900
    assert mart.reports_symptoms.count() == 601
    one = mart.reports.filter("CASE_ID = '0000001'").first()
    assert (one.NUM_VAX, one.FOLLOWUP_COUNT, one.VAX_COMBO) == (300, 300, "FLU")
    assert checks.failing_checks(mart) == []


def test_fields_of_a_case_without_vaccines(spark, tmp_path):
    mart = small_mart(spark, tmp_path, [dict(CASE_ID="1", HISTORY=" none ", LAB_DATA="ok", OTHER_MEDS="x")],
                      [dict(CASE_ID="2", VAX_TYPE="FLU"), dict(CASE_ID="1", VAX_TYPE="", REPORT_ORDER=1)])
    case = mart.reports.first()
    assert (case.NUM_VAX, case.VAX_TYPES, case.VAX_COMBO, case.FOLLOWUP_COUNT) == (1, [], None, 0)
    assert case.HAS_DATA == ["OTHER_MEDS", "LAB_DATA"]
    assert [r.CASE_ID for r in mart.reports_vax.collect()] == ["2"]  # orphans stay here


def test_each_check_notices_its_violation(spark):
    reports = spark.createDataFrame([("1",), ("1",), ("1",), ("2",)], "CASE_ID string")
    assert violations(checks.one_row_per_case(reports)) == 2
    assert violations(checks.not_empty(reports)) == 0
    assert violations(checks.not_empty(reports.limit(0))) == 1
    pairs = spark.createDataFrame([("1", 1), ("1", 1), ("1", 9)], "CASE_ID string, SYMPTOM_ID int")
    assert violations(checks.no_repeated_pairs(pairs)) == 1
    triples = spark.createDataFrame([("1", "F", None), ("1", "F", None)], "CASE_ID string, VAX_TYPE string, VAX_MANU string")
    assert violations(checks.no_repeated_triples(triples)) == 1
    words = spark.createDataFrame([(1, "a"), (3, "b")], "SYMPTOM_ID int, SYMPTOM string")
    assert violations(checks.dense_term_ids(words)) == 1
    assert violations(checks.dense_term_ids(words.limit(0))) == 1
    assert violations(checks.dense_term_ids(words.filter("SYMPTOM_ID = 1"))) == 0
    assert violations(checks.no_orphan_terms(pairs, words)) == 1
    many = spark.range(1, 65537).select(F.col("id").cast("int").alias("SYMPTOM_ID"), F.lit("x").alias("SYMPTOM"))
    assert violations(checks.vocabulary_size(many)) == 1
    assert violations(checks.vocabulary_size(many.filter("SYMPTOM_ID < 65536"))) == 0


def test_repeated_raw_lines(spark):
    raw = frame(spark, "submissions", [dict(CASE_ID="1", FILE_LINE_NO=1), dict(CASE_ID="1", FILE_LINE_NO=1)])
    assert violations(checks.unique_lines(raw, "submissions")) == 1


def test_rebuild_gives_the_same_ids(spark, mart):
    again = model.symptoms(model.vocabulary(mart.raw.terms))
    assert again.exceptAll(mart.symptoms).isEmpty()


@pytest.mark.parametrize("name", ["reports", "reports_vax", "vax_details", "reports_symptoms"])
def test_tables_are_bucketed_by_case(mart, name):
    plan = mart.table(name).groupBy("CASE_ID").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan


@pytest.mark.parametrize("table", ["vax_details", "reports_symptoms"])
def test_rows_are_exchanged_once_before_they_are_counted_by_case(spark, tmp_path, table):
    mart = small_mart(spark, tmp_path, [dict(CASE_ID="1")], [dict(CASE_ID="1", VAX_TYPE="FLU")] * 2,
                      [dict(CASE_ID="1", SYMPTOM1="Pain", SYMPTOM2="Pain")] * 2, buckets=3)
    filed = mart._define(table).repartition(3, "CASE_ID")  # as the store files it
    plan = filed._jdf.queryExecution().executedPlan().toString().split("Scan")[0]
    assert plan.count("Exchange hashpartitioning(CASE_ID") == 1
    first_counted = plan.rindex("HashAggregate")
    assert plan.index("Exchange hashpartitioning(CASE_ID") > first_counted  # printed from the last step to the first
    assert filed.count() == 1
