"""Text cleaning as Column expressions (all JVM-side)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from caselight import fixed_values as fv

_C1_CONTROLS = "".join(chr(b) for b in range(0x80, 0xA0))


def trim_spaces(text: Column) -> Column:
    """Strip every Unicode space separator (not only U+0020) from both ends.

    Pure ASCII text, nearly all of it, takes the plain trim, which is far cheaper.
    """
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.trim(text)).otherwise(F.trim(text, F.lit(fv.SPACE_SEPARATORS)))


def sql_trim_spaces(text: str) -> str:
    """``trim_spaces`` as SQL text."""
    return (
        f"CASE WHEN octet_length({text}) = char_length({text}) THEN trim({text}) "
        f"ELSE trim(BOTH '{fv.SPACE_SEPARATORS}' FROM {text}) END"
    )


def clean_null(text: Column, null_like: Sequence[str] = tuple(fv.NULL_LIKE)) -> Column:
    """NULL for blank or "nothing stated" texts, the text itself (untrimmed) otherwise."""
    core = F.lower(trim_spaces(text))
    return F.when(~core.isin("", *null_like), text)


def decode_windows_1252(latin1_text: Column) -> Column:
    """Text that was read as ISO-8859-1 -> what windows-1252 would have given.

    The two code pages differ only at 0x80..0x9F, so one ``translate`` is enough and no
    legacy charset flag is needed. Pure ASCII text, nearly all of it, is left as it is.
    """
    ascii_only = F.octet_length(latin1_text) == F.char_length(latin1_text)
    return F.when(ascii_only, latin1_text).otherwise(F.translate(latin1_text, _C1_CONTROLS, fv.CP1252_HIGH))


def unix_newlines(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def first_lines(text: Column, lines: int = fv.EXCERPT_LINES) -> Column:
    """The first ``lines`` lines; NULL reads as an empty text."""
    return F.substring_index(F.coalesce(text, F.lit("")), "\n", lines)


def register_sql_functions(spark: SparkSession) -> None:
    """Offer ``clean_null(x)`` to plain SQL users of this session."""
    members = ", ".join("'" + w.replace("'", "''") + "'" for w in ["", *fv.NULL_LIKE])
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION clean_null(x STRING) RETURNS STRING RETURN "
        f"CASE WHEN lower({sql_trim_spaces('x')}) NOT IN ({members}) THEN x END"
    )
