import datetime as dt

import pytest
from pyspark.sql import functions as F

from caselight import fixed_values as fv
from caselight.functions import derive, text


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)
            .select(column).collect()]


def test_clean_null_truth_table(spark):
    gone = [None, "", "   ", " ", *fv.NULL_LIKE, *[w.upper() for w in fv.NULL_LIKE],
            *[f" {w} " for w in fv.NULL_LIKE]]
    kept = ["unknown.", "none reported.", " asthma ", "nkda nka", "no known allergy"]
    text.register_sql_functions(spark)
    df = spark.createDataFrame([(x,) for x in gone + kept], "x string")
    for column in (text.clean_null(F.col("x")), F.expr("clean_null(x)")):
        assert [r[0] for r in df.select(column).collect()] == [None] * len(gone) + kept


def test_trim_strips_every_space_separator_but_no_tabs(spark):
    rows = [f"{s}a b{s}" for s in fv.SPACE_SEPARATORS] + ["\ta\t", None, "é "]
    found = values(spark, rows, "x string", text.trim_spaces(F.col("x")))
    assert found == ["a b"] * len(fv.SPACE_SEPARATORS) + ["\ta\t", None, "é"]
    assert values(spark, rows, "x string", F.expr(text.sql_trim_spaces("x"))) == found


def test_decode_matches_the_code_page(spark):
    every_byte = bytes(range(1, 256))
    found = values(spark, [every_byte.decode("latin-1")], "x string", text.decode_windows_1252(F.col("x")))
    assert found[0] == every_byte.decode("cp1252", errors="replace")


def test_excerpt(spark):
    many = "\n".join(str(i) for i in range(12))
    found = values(spark, [None, "one", many], "x string", text.first_lines(F.col("x")))
    assert found == ["", "one", "\n".join(str(i) for i in range(10))]


@pytest.mark.parametrize("stored, onset, expected", [
    (10000, None, 10000), (10001, None, None), (-5, None, -5), (20000, 3, None),
    (None, 3, 3), (None, -3, 3), (None, None, None), (None, 10000, 10000), (None, 10001, None),
])
def test_onset_delay(spark, stored, onset, expected):
    day = dt.date(2000, 1, 1)
    other = None if onset is None else day + dt.timedelta(onset)
    df = spark.createDataFrame([(stored, day, other)], "n int, v date, o date")
    assert df.select(derive.onset_delay(F.col("n"), F.col("v"), F.col("o"))).first()[0] == expected


def test_bins_at_their_edges(spark):
    ages = [None, -0.1, 0.0, 0.99, 1.0, 2.0, 4.0, 9.99, 10.0, 20.0, 40.0, 59.9, 60.0, 120.0]
    found = values(spark, ages, "a double", F.expr(derive.sql_range_bucket("a", fv.AGE_BUCKETS)))
    assert found == [None, None, "0-1", "0-1", "1-2", "2-4", "4-10", "4-10", "10-20", "20-40", "40-60", "40-60",
                     "60+", "60+"]
    lags = [None, -1, 0, 7, 8, 30, 31, 90, 91, 365, 366, 730, 731]
    found = values(spark, lags, "a int", F.expr(derive.sql_upper_bound_bin("a", fv.LAG_BINS)))
    assert found == [None, "<0", "0-7", "0-7", "8-30", "8-30", "31-90", "31-90", "91-365", "91-365", "366-730",
                     "366-730", "731+"]
    found = values(spark, [0, 1, 2, 3, 5, 6], "a int", F.expr(derive.sql_upper_bound_bin("a", fv.FOLLOWUP_BINS)))
    assert found == ["0", "1", "2", "3-5", "3-5", "6+"]


def test_rate():
    assert [derive.rate_multiplier(r) for r in (None, 0, -3, "x", 100, "50", 10)] == [1, 1, 1, 1, 1, 2, 10]


def test_scaled_rounds_half_up(spark):
    assert values(spark, [1, 3, 5], "n bigint", derive.scaled(F.col("n"), 200)) == [1, 2, 3]


def test_outcome_labels(spark):
    df = spark.createDataFrame(
        [("Y", "", None, "Y", "N", "Y", "x")],
        "DIED string, L_THREAT string, HOSPITAL string, DISABLE string, RECOVD string, ER_VISIT string, ER_ED_VISIT string")
    assert df.select(derive.outcome_labels()).first()[0] == ["DIED", "DISABLED", "ER", "NOT RECOVERED"]
