"""Versions of the bronze tables: what readers see of runs that end, fail, or race."""

import pytest
from tests.feed_files import record, write_feed

from caselight.sources import ingest as loading
from caselight.sources import versions
from caselight.sources.feed import FeedError
from caselight.sources.ingest import bronze_table, ingest


def sub(case, **values):
    return record("submissions", None, CASE_ID=case, **values)


def vax(case, kind):
    return record("vaccines", None, CASE_ID=case, VAX_TYPE=kind)


def feed(folder, year, cases, kind="FLU4"):
    write_feed(folder / f"{year}DATA.csv", "submissions", [sub(c) for c in cases])
    write_feed(folder / f"{year}VAX.csv", "vaccines", [vax(c, kind) for c in cases])
    return str(folder)


def held(spark, bronze, version=None):
    return {t: sorted((r.FILE_NAME[:4], r.CASE_ID) for r in bronze_table(spark, bronze, t, version).collect())
            for t in ("submissions", "vaccines")}


@pytest.fixture
def loaded(spark, tmp_path):
    bronze = str(tmp_path / "b")
    ingest(spark, feed(tmp_path / "one", 2020, ["1", "2"]), bronze)
    return bronze


def test_each_version_keeps_its_files(spark, tmp_path, loaded):
    first = held(spark, loaded)
    ingest(spark, feed(tmp_path / "two", 2021, ["3"]), loaded, append=True)
    ingest(spark, feed(tmp_path / "three", 2020, ["1", "4"]), loaded, append=True)
    assert [v.number for v in versions.versions(spark, loaded)] == [1, 2, 3]
    assert held(spark, loaded, 1) == first
    assert held(spark, loaded, 2)["submissions"] == [("2020", "1"), ("2020", "2"), ("2021", "3")]
    assert held(spark, loaded)["vaccines"] == [("2020", "1"), ("2020", "4"), ("2021", "3")]
    with pytest.raises(FeedError, match="no version 9"):
        bronze_table(spark, loaded, "terms", 9)


def test_a_run_killed_between_two_tables_leaves_the_old_version(spark, tmp_path, loaded, monkeypatch):
    before = held(spark, loaded)
    usual = loading._load_table

    def killed(spark, table, *rest):
        if table == "vaccines":
            raise KeyboardInterrupt
        return usual(spark, table, *rest)

    source = feed(tmp_path / "two", 2020, ["7", "8", "9"])
    with monkeypatch.context() as patch, pytest.raises(KeyboardInterrupt):
        patch.setattr(loading, "_load_table", killed)
        ingest(spark, source, loaded, append=True)
    assert held(spark, loaded) == before and len(versions.versions(spark, loaded)) == 1
    ingest(spark, source, loaded, append=True)
    assert held(spark, loaded)["submissions"] == [("2020", "7"), ("2020", "8"), ("2020", "9")]
    gone = versions.remove_unused(spark, loaded, keep=1)
    assert len(gone) == 2 and held(spark, loaded)["vaccines"] == [("2020", "7"), ("2020", "8"), ("2020", "9")]


def test_repeated_keys_stop_the_publish(spark, tmp_path, loaded, monkeypatch):
    before = held(spark, loaded)
    usual = loading.number_lines
    monkeypatch.setattr(loading, "number_lines", lambda rows: usual(rows).unionByName(usual(rows).where("CASE_ID = '5'")))
    with pytest.raises(FeedError, match="repeated keys .* vaccines of 2021VAX.CSV: 1"):
        ingest(spark, feed(tmp_path / "two", 2021, ["4", "5"]), loaded, append=True)
    assert held(spark, loaded) == before
    audit = spark.read.parquet(f"{loaded}/import_summary").where("file_name like '2021%'").collect()
    assert sorted((r.file_name, r.rows_imported) for r in audit) == [("2021DATA.CSV", 0), ("2021VAX.CSV", 0)]


def test_only_one_of_two_runs_takes_a_number(spark, tmp_path, loaded):
    base = versions.latest(spark, loaded)
    files = versions.manifest(spark, loaded, base)
    assert versions.publish(spark, loaded, base, "a", files).number == 2
    with pytest.raises(FeedError, match="another run"):
        versions.publish(spark, loaded, base, "b", files)
    # both wrote the log at once: every reader takes the same one
    spark.createDataFrame([(3, "y"), (3, "x")], "number bigint, run string").selectExpr(
        "number", "run", "current_timestamp() AS published_at").write.mode("append").parquet(f"{loaded}/versions")
    assert versions.latest(spark, loaded) == versions.Version(3, "x")


def test_a_load_without_a_readable_file_publishes_nothing(spark, tmp_path, loaded):
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "2020DATA.csv").write_text("a,b\n1,2\n")
    before = held(spark, loaded)
    with pytest.raises(FeedError, match="lacks"):
        ingest(spark, str(tmp_path / "bad"), loaded)
    assert held(spark, loaded) == before


def test_altered_files_are_told(spark, tmp_path, loaded):
    version = versions.latest(spark, loaded)
    assert versions.altered_files(spark, loaded, version).count() == 0
    extra = spark.read.parquet(f"{loaded}/vaccines").where("CASE_ID = '1'")
    extra.write.mode("append").partitionBy("run", "FILE_NAME").parquet(f"{loaded}/vaccines")
    assert [tuple(r) for r in versions.altered_files(spark, loaded, version).collect()] == [("vaccines", "2020VAX.CSV", 2, 3)]


def test_a_version_reads_only_its_files(spark, tmp_path, loaded):
    ingest(spark, feed(tmp_path / "two", 2020, ["7"]), loaded, append=True)
    ingest(spark, feed(tmp_path / "three", 2021, ["8"]), loaded, append=True)
    files = bronze_table(spark, loaded, "submissions").inputFiles()
    plan = bronze_table(spark, loaded, "submissions")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "run#" in plan
    runs = {f.split("run=")[1].split("/")[0] for f in files}
    assert versions.versions(spark, loaded)[0].run not in runs and len(runs) == 2


LINES = "CASE_ID string, FILE_NAME string, FILE_LINE_NO int"


def keys_told(spark, rows):
    found = versions.file_keys(spark.createDataFrame(rows, LINES), "terms", "r").collect()
    return {r.file_name: (r.rows, r.key_digest, r.repeated) for r in found}


def test_keys_of_lines_that_differ_are_not_exchanged(spark):
    rows = [(f"{i % 7}", f"F{i % 2}", i // 2 + 1) for i in range(400)]
    text = versions.file_keys(spark.createDataFrame(rows, LINES), "terms", "r")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(CASE_ID" not in text
    far = keys_told(spark, [(c, f, n * 1000) for c, f, n in rows])
    near = keys_told(spark, rows)
    assert {k: (v[0], v[2]) for k, v in near.items()} == {k: (v[0], v[2]) for k, v in far.items()} == {"F0": (200, 0), "F1": (200, 0)}


def test_keys_told_by_bits_are_those_of_a_grouping(spark, monkeypatch):
    odd = [("a", "F", 1), ("a", "F", 2), ("b", "F", None), (None, "F", 4), ("a", "G", -3), ("a", "G", -2), ("c", None, 1), ("c", None, 2)]
    for rows in ([("a", "F", n) for n in range(-40, 90)], odd, [*odd, ("a", "F", 1)], [("a", "F", 1), ("b", "F", 1)], []):
        found = keys_told(spark, rows)
        with monkeypatch.context() as patch:
            patch.setattr(versions, "_lines_differ", lambda _: False)
            assert found == keys_told(spark, rows)
