"""A refreshed model equals a full build of the same feed."""

import pytest
from tests.feed_files import record, write_feed

from caselight.operators import cases
from caselight.operators.filters import FilterSpec, matching_cases
from caselight.plans import refresh
from caselight.plans.mart import open_model
from caselight.plans.refresh import COMPARED, build_from_bronze, refresh_model
from caselight.sources.ingest import ingest


def feed(folder, year, cases, term="Pain", manu="M"):
    write_feed(folder / f"{year}DATA.csv", "submissions",
               [record("submissions", o, CASE_ID=c, STATE=f"{year}", VAX_DATE="1/2/2020", SYMPTOM_TEXT=f"text {c}") for c, o in cases],
               order_column=True)
    write_feed(folder / f"{year}VAX.csv", "vaccines",
               [record("vaccines", CASE_ID=c, VAX_TYPE="FLU4", VAX_MANU=manu) for c, _ in cases])
    write_feed(folder / f"{year}SYMPTOMS.csv", "terms", [record("terms", CASE_ID=c, SYMPTOM1=term, SYMPTOM2="Fever") for c, _ in cases])
    return str(folder)


def rows(df):
    return sorted((tuple(sorted((k, repr(v)) for k, v in r.asDict().items())) for r in df.collect()))


def same_as_full(spark, tmp_path, bronze, mart, name):
    full = build_from_bronze(spark, bronze, str(tmp_path / f"full-{name}"), mart.store.buckets)
    for table in COMPARED:
        assert rows(mart.table(table)) == rows(full.table(table)), table


def test_refresh(spark, tmp_path):
    bronze, folder = str(tmp_path / "b"), str(tmp_path / "m")
    many = [(f"{i:07d}", "1") for i in range(60)]
    ingest(spark, feed(tmp_path / "a", 2019, many), bronze)
    build_from_bronze(spark, bronze, folder, 40)
    assert refresh_model(spark, bronze, folder).touched == 0

    # the same terms; a follow-up of an old case, one new case
    ingest(spark, feed(tmp_path / "c", 2020, [("0000003", "2"), ("0000900", "1")]), bronze, append=True)
    found = refresh_model(spark, bronze, folder)
    assert not found.full and found.touched <= 2 and 0 < found.bytes_read < found.bytes_held / 4
    assert len(found.mart.store.parts["reports_symptoms"]) == 2
    same_as_full(spark, tmp_path, bronze, found.mart, "same")
    text = found.mart.reports.groupBy("CASE_ID").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text  # parts keep the bucketing

    # the file comes again: a case goes, another comes, a term is new and moves the ids
    ingest(spark, feed(tmp_path / "d", 2020, [("0000901", "1")], term="Ache", manu="N"), bronze, append=True)
    found = refresh_model(spark, bronze, folder)
    assert not found.full and len(found.mart.store.parts["reports"]) == 3
    same_as_full(spark, tmp_path, bronze, found.mart, "moved")

    served = open_model(spark.newSession(), folder)
    ask = lambda field, value, op="=": FilterSpec.from_request(
        {"adhoc": [{"field": field, "op": op, "value": value}]})
    assert [r.CASE_ID for r in matching_cases(served, ask("SYMPTOMS", "ache")).collect()] == ["0000901"]
    assert matching_cases(served, ask("VAX_MANU", "N", "!=")).count() == 60
    assert matching_cases(served, ask("SYMPTOMS", "unheard of")).count() == 0
    assert cases.case_dossier(served, "0000003")["reports"].count() == 1  # its follow-up went with the file


def test_many_touched_buckets_build_in_full(spark, tmp_path, monkeypatch):
    bronze, folder = str(tmp_path / "b"), str(tmp_path / "m")
    ingest(spark, feed(tmp_path / "a", 2019, [(str(i), "1") for i in range(8)]), bronze)
    build_from_bronze(spark, bronze, folder, 2)
    ingest(spark, feed(tmp_path / "c", 2020, [(str(i), "1") for i in range(8, 16)]), bronze, append=True)
    found = refresh_model(spark, bronze, folder)
    assert found.full and found.mart.reports.count() == 16


def test_one_case_reads_one_bucket(mart):
    conf = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    mart.spark.conf.set(conf, "false")
    try:
        for df in (cases.dossier_submissions(mart, ["0000001"]), cases.dossier_vaccines(mart, ["0000001"]),
                   cases.dossier_terms(mart, ["0000001"])):
            text = df._jdf.queryExecution().executedPlan().toString()
            assert f"SelectedBucketsCount: 1 out of {mart.store.buckets}" in text
    finally:
        mart.spark.conf.unset(conf)


@pytest.mark.parametrize("field, table", [("SYMPTOMS", "term_cases"), ("VAX_MANU", "manu_cases")])
def test_a_membership_reads_one_folder_of_the_postings(mart, field, table):
    from caselight.operators.filters import Membership, _members

    found = _members(mart, Membership("manu" if field == "VAX_MANU" else "symptom", "Brand#4", False))
    every = mart.table(table)
    assert 0 < len(found.inputFiles()) and found.count() > 0
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in text
    read = found.select("_metadata.file_path").distinct().count() if "_metadata" in found.columns else None
    folders = {f.split("part=")[1].split("/")[0] for f in every.inputFiles()}
    assert len(folders) > 1 and read in (None, 1)


def test_a_full_refresh_does_not_read_the_files_that_stay(spark, tmp_path, monkeypatch):
    """Raw rows that the model holds by case are taken from there; the result is that of a build from all files."""
    bronze, folder = str(tmp_path / "b"), str(tmp_path / "m")
    ingest(spark, feed(tmp_path / "a", 2019, [(f"{i:07d}", "1") for i in range(20)]), bronze)
    ingest(spark, feed(tmp_path / "c", 2020, [(f"{i:07d}", "1") for i in range(20, 30)]), bronze, append=True)
    build_from_bronze(spark, bronze, folder, 3)
    # one file comes again with other cases and a follow-up
    again = [("0000003", "2"), *((f"{i:07d}", "1") for i in range(40, 60))]
    ingest(spark, feed(tmp_path / "d", 2020, again, term="Ache", manu="N"), bronze, append=True)
    with monkeypatch.context() as patch:
        patch.setattr(refresh, "build_from_bronze", lambda *a, **b: pytest.fail("all files are read again"))
        found = refresh_model(spark, bronze, folder)
    assert found.full and found.mart.store.buckets == 3 and found.mart.reports.count() == 40
    same_as_full(spark, tmp_path, bronze, found.mart, "anew")
    assert refresh_model(spark, bronze, folder).touched == 0
