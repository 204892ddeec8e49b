"""A run works on its tables at the same time."""

from __future__ import annotations

import threading

from caselight.session import side_by_side
from caselight.sources import ingest as module
from caselight.sources import versions
from tests.test_ingest import feed_of_three_tables


def test_tables_are_parsed_and_counted_at_the_same_time(spark, tmp_path, monkeypatch):
    feed_of_three_tables(tmp_path / "in", [("1", "1")])
    met = threading.Barrier(3, timeout=120)
    for step in ("read_feed", "unparseable_counts"):
        def meet(*given, usual=getattr(module, step)):
            met.wait()  # raises if the tables come one after the other
            return usual(*given)

        monkeypatch.setattr(module, step, meet)
    report = module.ingest(spark, str(tmp_path / "in"), str(tmp_path / "b"))
    assert set(report.imported.values()) == {1}


def test_typed_tables_are_written_at_the_same_time(spark, tmp_path, monkeypatch):
    feed_of_three_tables(tmp_path / "in", [("1", "1")])
    module.ingest(spark, str(tmp_path / "in"), str(tmp_path / "b"))
    tables = {t: module.bronze_table(spark, str(tmp_path / "b"), t) for t in module.TABLE_COLUMNS}
    met, usual = threading.Barrier(3, timeout=120), versions.file_keys

    def meet(*given):
        met.wait()
        return usual(*given)

    monkeypatch.setattr(versions, "file_keys", meet)
    assert versions.add_tables(spark, str(tmp_path / "c"), tables).number == 1


def test_results_come_in_the_order_of_the_items(spark):
    assert side_by_side(spark, lambda i: -i, [3, 1, 2]) == [-3, -1, -2] and side_by_side(spark, abs, []) == []
