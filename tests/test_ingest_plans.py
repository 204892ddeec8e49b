"""What a load costs: code that the JVM compiles."""

from __future__ import annotations

import re
from contextlib import contextmanager

from caselight.sources.feed import header_of, list_feed, read_feed
from tests.feed_files import record, write_feed

#: Bytes of a method's code beyond which the JVM runs it uncompiled.
HUGE_METHOD = 8000


@contextmanager
def fixed_plans(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_wide_records_are_parsed_by_compiled_code(spark, tmp_path):
    several_lines = record("submissions", "1", CASE_ID="1", SYMPTOM_TEXT="a\nb")
    write_feed(tmp_path / "2020Data.csv", "submissions", [several_lines], order_column=True)
    with fixed_plans(spark):
        files = list_feed(spark, [str(tmp_path)])
        rows = read_feed(spark, "submissions", {f: header_of(spark, f) for f in files})
        code = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < HUGE_METHOD
    assert rows.first().SYMPTOM_TEXT == "a\nb"
