import datetime as dt

import pytest
from tests.feed_files import record, write_feed

from caselight.plans.mart import build_model, model_is_usable, open_model
from caselight.plans.checks import ModelError
from caselight.sources.feed import FeedError, latest_vintage, list_feed, table_for
from caselight.sources.ingest import bronze_table, bronze_tables, ingest



def sub(case, order=None, **values):
    return record("submissions", order, CASE_ID=case, **values)


BLOCKS = [150, 400, 5_000, 128 << 20]


@pytest.fixture(params=BLOCKS)
def blocks(spark, request):
    """Cut text files into blocks of so many bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def quirks(folder):
    text = 'said "no"\r\nthen,\rlater\n\nend'
    return write_feed(folder / "2020Data.csv", "submissions", [
        sub("0000001", RECVDATE="01/02/2020", SYMPTOM_TEXT=text, AGE_YRS="1.5", NUMDAYS="3"),
        sub("0000002", RECVDATE="1/2/2020", STATE="\x93caf\xe9\x94\x81"),
        "0000003,too,short",
        sub("0000004", RECVDATE="13/45/2020", AGE_YRS="abc", SYMPTOM_TEXT="line\r\n" * 30),
        ",".join(sub("0000005")) + ",one,too,many",
        sub("0000006", SYMPTOM_TEXT='"'),
        sub("0000007", TODAYS_DATE="12/31/1999"),
    ])


def test_quirks_of_the_feed(spark, tmp_path, blocks):
    quirks(tmp_path / "in")
    report = ingest(spark, str(tmp_path / "in"), str(tmp_path / "bronze"))
    assert report.imported == {"2020DATA.CSV": 5}
    assert report.rejected == {"2020DATA.CSV": 2}
    assert report.unparseable == {("2020DATA.CSV", "RECVDATE"): 1, ("2020DATA.CSV", "AGE_YRS"): 1}
    rows = {r.CASE_ID: r for r in bronze_table(spark, str(tmp_path / "bronze"), "submissions").collect()}
    assert sorted(rows) == ["0000001", "0000002", "0000004", "0000006", "0000007"]
    one = rows["0000001"]
    assert one.SYMPTOM_TEXT == 'said "no"\nthen,\nlater\n\nend'
    assert (one.RECVDATE, one.AGE_YRS, one.NUMDAYS, one.SEX) == (dt.date(2020, 1, 2), 1.5, 3, None)
    assert rows["0000002"].RECVDATE == dt.date(2020, 1, 2)
    assert rows["0000002"].STATE == "“café”�"
    assert rows["0000004"].RECVDATE is None and rows["0000004"].AGE_YRS is None
    assert rows["0000004"].SYMPTOM_TEXT == "line\n" * 30
    assert rows["0000006"].SYMPTOM_TEXT == '"'
    assert rows["0000007"].TODAYS_DATE == dt.date(1999, 12, 31)
    # the line number counts accepted rows
    assert [rows[k].FILE_LINE_NO for k in sorted(rows)] == [1, 2, 3, 4, 5]
    assert {r.REPORT_ORDER for r in rows.values()} == {1}
    rejects = spark.read.parquet(str(tmp_path / "bronze" / "rejects")).collect()
    assert len(rejects) == 2 and any("too,short" in r.csv_line for r in rejects)


def test_records_do_not_depend_on_the_block_size(spark, tmp_path, blocks):
    rows = [
        sub(f"{i:07d}", SYMPTOM_TEXT=("x\r\n" * (i % 5)) + ('"q"' if i % 3 else "") + "é" * (i % 7))
        for i in range(200)
    ]
    write_feed(tmp_path / "in" / "2021DATA.csv", "submissions", rows)
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "b"))
    table = bronze_table(spark, str(tmp_path / "b"), "submissions")
    found = sorted(map(tuple, table.select("CASE_ID", "FILE_LINE_NO", "SYMPTOM_TEXT").collect()))
    assert [r[:2] for r in found] == [(f"{i:07d}", i + 1) for i in range(200)]
    assert all((t or "") == ("x\n" * (i % 5)) + ('"q"' if i % 3 else "") + "é" * (i % 7) for i, (_, _, t) in enumerate(found))


def _file_of(folder, rows: list[str], end: str = "\n"):
    """A vaccine file of raw lines."""
    from caselight import fixed_values as fv

    folder.mkdir(parents=True, exist_ok=True)
    (folder / "2020VAX.csv").write_bytes(end.join([",".join(fv.VACCINE_COLUMNS), *rows, ""]).encode("latin-1"))
    return len(fv.VACCINE_COLUMNS)


def _vaccines(spark, tmp_path):
    report = ingest(spark, str(tmp_path / "in"), str(tmp_path / "b"))
    rows = bronze_table(spark, str(tmp_path / "b"), "vaccines").select("CASE_ID", "VAX_TYPE").collect()
    return report.imported["2020VAX.CSV"], report.rejected["2020VAX.CSV"], {r[0]: r[1] for r in rows}


def _line(i: int, kind: str) -> str:
    return ",".join([f"{i:07d}", kind, *[""] * 6])


def test_a_quote_inside_a_field_opens_nothing(spark, tmp_path, blocks):
    _file_of(tmp_path / "in", [_line(i, "5'11\" tall" if i == 3 else "FLU4") for i in range(20)])
    assert _vaccines(spark, tmp_path)[:2] == (20, 0)


def test_a_lone_carriage_return_ends_a_record(spark, tmp_path, blocks):
    _file_of(tmp_path / "in", [_line(0, "A"), _line(1, "B") + "\r" + _line(2, "C"), _line(3, '"D\rE"'), _line(4, "F")])
    imported, rejected, rows = _vaccines(spark, tmp_path)
    assert (imported, rejected) == (5, 0) and rows["0000003"] == "D\nE"


def test_an_open_quote_costs_its_own_line(spark, tmp_path, blocks):
    _file_of(tmp_path / "in", [_line(i, '"open' if i == 3 else '"x, y"' if i % 4 == 1 else "FLU4") for i in range(20)])
    imported, rejected, rows = _vaccines(spark, tmp_path)
    assert imported == 19 and rejected == 1 and "0000003" not in rows and rows["0000005"] == "x, y"


def test_a_full_load_replaces_every_table(spark, tmp_path):
    write_feed(tmp_path / "one" / "2020DATA.csv", "submissions", [sub("1")])
    write_feed(tmp_path / "one" / "2020VAX.csv", "vaccines", [record("vaccines", CASE_ID="1", VAX_TYPE="FLU4")])
    write_feed(tmp_path / "two" / "2021DATA.csv", "submissions", [sub("2")])
    ingest(spark, str(tmp_path / "one"), str(tmp_path / "b"))
    ingest(spark, str(tmp_path / "two"), str(tmp_path / "b"))
    assert bronze_table(spark, str(tmp_path / "b"), "vaccines").count() == 0
    assert [r.CASE_ID for r in bronze_table(spark, str(tmp_path / "b"), "submissions").collect()] == ["2"]


def test_a_failed_file_has_an_audit_row(spark, tmp_path):
    write_feed(tmp_path / "in" / "2020DATA.csv", "submissions", [sub("1")])
    (tmp_path / "in" / "2021DATA.csv").write_text("a,b\n1,2\n")
    with pytest.raises(FeedError):
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "b"))
    audit = {r.file_name: r.rows_imported for r in spark.read.parquet(str(tmp_path / "b" / "import_summary")).collect()}
    assert audit == {"2020DATA.CSV": 1, "2021DATA.CSV": 0}


def test_numbering_runs_across_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("caselight.sources.ingest.NUMBERING_CHUNK", 7)
    write_feed(tmp_path / "in" / "2021DATA.csv", "submissions", [sub(f"{i:07d}") for i in range(50)])
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "b"))
    rows = bronze_table(spark, str(tmp_path / "b"), "submissions").orderBy("CASE_ID").collect()
    assert [r.FILE_LINE_NO for r in rows] == list(range(1, 51))


def test_order_column_and_header_drift(spark, tmp_path):
    write_feed(tmp_path / "in" / "2024DATA.csv", "submissions", [sub("1")])
    write_feed(tmp_path / "in" / "2025DATA.csv", "submissions",
               [sub("2", "2"), sub("3", ""), sub("4", "x")], order_column=True)
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "b"))
    table = bronze_table(spark, str(tmp_path / "b"), "submissions")
    assert {r.CASE_ID: r.REPORT_ORDER for r in table.collect()} == {"1": 1, "2": 2, "3": 1, "4": 1}


def test_names_route_files(spark, tmp_path):
    assert table_for("2020xDATA.csv", "x") == "submissions"
    assert table_for("2020DATA.csv", "x") is None
    assert table_for("notes.csv") is None
    folder = tmp_path / "in"
    write_feed(folder / "NonDomesticVAX.csv", "vaccines", [record("vaccines", CASE_ID="1", VAX_TYPE="FLU4")])
    write_feed(folder / "2020SYMPTOMS.csv", "terms", [record("terms", CASE_ID="1", SYMPTOM1="Pain")])
    write_feed(folder / "notes.csv", "terms", [])
    report = ingest(spark, str(folder), str(tmp_path / "b"))
    assert report.skipped == ["notes.csv"]
    row = bronze_table(spark, str(tmp_path / "b"), "vaccines").first()
    assert (row.FILE_NAME, row.IS_DOMESTIC) == ("NONDOMESTICVAX.CSV", False)
    assert spark.read.parquet(str(tmp_path / "b" / "terms")).first().IS_DOMESTIC is True


def test_named_files_and_missing_ones(spark, tmp_path):
    one = write_feed(tmp_path / "in" / "2020DATA.csv", "submissions", [sub("1")])
    write_feed(tmp_path / "in" / "2021DATA.csv", "submissions", [sub("2")])
    report = ingest(spark, [one, str(tmp_path / "in" / "2022DATA.csv"), "x.txt"], str(tmp_path / "b"))
    assert report.missing == [str(tmp_path / "in" / "2022DATA.csv")]
    assert bronze_table(spark, str(tmp_path / "b"), "submissions").count() == 1


def test_replace_by_file(spark, tmp_path):
    bronze = str(tmp_path / "b")

    def load(delivery, name, rows):
        folder = tmp_path / delivery
        write_feed(folder / name, "submissions", rows)
        return ingest(spark, str(folder), bronze, append=True)

    def stored():
        return sorted((r.FILE_NAME, r.CASE_ID) for r in bronze_table(spark, bronze, "submissions").collect())

    load("d1", "2020Data.csv", [sub("1"), sub("2")])
    load("d2", "2021Data.csv", [sub("3")])
    load("d3", "2021Data.csv", [sub("3")])
    assert stored() == [("2020DATA.CSV", "1"), ("2020DATA.CSV", "2"), ("2021DATA.CSV", "3")]
    # the same file under another spelling replaces it, the other file stays
    load("d4", "2020DATA.csv", [sub("1"), sub("9")])
    assert stored() == [("2020DATA.CSV", "1"), ("2020DATA.CSV", "9"), ("2021DATA.CSV", "3")]
    # a file without rows must not wipe the stored year
    report = load("d5", "2020DATA.csv", [])
    assert report.kept_existing == ["2020DATA.CSV"]
    assert len(stored()) == 3
    audit = spark.read.parquet(f"{bronze}/import_summary")
    assert audit.filter("file_name = '2020DATA.CSV'").count() == 3
    # a full load starts over
    ingest(spark, str(tmp_path / "d2"), bronze)
    assert stored() == [("2021DATA.CSV", "3")]


def test_later_delivery_wins(spark, tmp_path):
    write_feed(tmp_path / "all" / "2020DATA.csv", "submissions", [sub("1")])
    write_feed(tmp_path / "all" / "2021DATA.csv", "submissions", [sub("2")])
    write_feed(tmp_path / "year" / "2021data.csv", "submissions", [sub("2"), sub("3")])
    both = [list_feed(spark, [str(tmp_path / d)]) for d in ("all", "year")]
    ingest(spark, latest_vintage(both), str(tmp_path / "b"))
    assert bronze_table(spark, str(tmp_path / "b"), "submissions").count() == 3
    with pytest.raises(FeedError, match="same file"):
        ingest(spark, [f for delivery in both for f in delivery], str(tmp_path / "c"))


def test_bad_file_fails_the_run_after_the_others_loaded(spark, tmp_path):
    write_feed(tmp_path / "in" / "2020DATA.csv", "submissions", [sub("1")])
    (tmp_path / "in" / "2021DATA.csv").write_text("REPORT_ID,STATE\n1,CA\n")
    with pytest.raises(FeedError, match="2021DATA.csv: lacks RECVDATE"):
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "b"))
    assert bronze_table(spark, str(tmp_path / "b"), "submissions").count() == 1


def feed_of_three_tables(folder, cases):
    write_feed(folder / "2020DATA.csv", "submissions", [sub(c, o) for c, o in cases], order_column=True)
    write_feed(folder / "2020VAX.csv", "vaccines",
               [record("vaccines", CASE_ID=c, VAX_TYPE="FLU4", VAX_MANU="M") for c, _ in cases])
    write_feed(folder / "2020SYMPTOMS.csv", "terms",
               [record("terms", CASE_ID=c, SYMPTOM1=" Pain\xa0", SYMPTOM2="Fever") for c, _ in cases])


def test_from_files_to_published_model(spark, tmp_path):
    feed_of_three_tables(tmp_path / "in", [("1", "1"), ("1", "2"), ("2", ""), ("3", "2")])
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "b"))
    folder = str(tmp_path / "model")
    assert not model_is_usable(spark, folder)
    build_model(bronze_tables(spark, str(tmp_path / "b")), spark, folder)
    assert model_is_usable(spark, folder)
    served = open_model(spark, folder)
    rows = {r.CASE_ID: r for r in served.reports.collect()}
    assert sorted(rows) == ["1", "2"]  # a follow-up without primary is no case
    assert rows["1"].FOLLOWUP_COUNT == 1
    assert [r.SYMPTOM for r in served.symptoms.orderBy("SYMPTOM_ID").collect()] == ["Fever", "Pain"]
    served.register_views(id_name="REPORT_KEY")
    assert spark.sql("SELECT count(REPORT_KEY) FROM reports_symptoms").first()[0] == 4


def test_failed_build_keeps_the_published_model(spark, tmp_path):
    folder = str(tmp_path / "model")
    feed_of_three_tables(tmp_path / "good", [("1", "1")])
    ingest(spark, str(tmp_path / "good"), str(tmp_path / "b"))
    build_model(bronze_tables(spark, str(tmp_path / "b")), spark, folder)
    feed_of_three_tables(tmp_path / "bad", [("1", "1"), ("1", "1")])
    ingest(spark, str(tmp_path / "bad"), str(tmp_path / "b"))
    with pytest.raises(ModelError, match="reports_one_row_per_case: 1"):
        build_model(bronze_tables(spark, str(tmp_path / "b")), spark, folder)
    assert open_model(spark, folder).reports.count() == 1
    with pytest.raises(ModelError, match="vocabulary"):
        build_model(bronze_tables(spark, str(tmp_path / "b")), spark, folder, max_terms=1)


def test_blocks_of_a_chosen_size_share_tasks_and_plain_files_keep_their_order(spark, tmp_path):
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    rows = [sub(f"{i:07}", RECVDATE="1/2/2020") for i in range(200)]
    rows[50] = "0000050,too,short"
    write_feed(tmp_path / "feed" / "2020Data.csv", "submissions", rows)
    write_feed(tmp_path / "feed" / "2021Data.csv", "submissions",
               [sub(f"{i:07}", SYMPTOM_TEXT="a\nb\nc") for i in range(200, 230)])
    report = ingest(spark, str(tmp_path / "feed"), str(tmp_path / "bronze"), block_bytes=100)
    assert report.rejected["2020DATA.CSV"] == 1 and spark.conf.get("spark.sql.files.maxPartitionBytes") == usual
    loaded = bronze_table(spark, str(tmp_path / "bronze"), "submissions")
    found = {(r.FILE_NAME, r.FILE_LINE_NO): r.CASE_ID for r in loaded.collect()}
    first = [f"{i:07}" for i in range(200) if i != 50]
    assert found == {("2020DATA.CSV", n): c for n, c in enumerate(first, 1)} | {
        ("2021DATA.CSV", n): f"{199 + n:07}" for n in range(1, 31)}
    files = list((tmp_path / "bronze" / "submissions").rglob("*.parquet"))
    assert len(files) <= 4 * spark.sparkContext.defaultParallelism
