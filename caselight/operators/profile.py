"""What values a filterable field can take, so a caller can offer the right input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caselight import fixed_values as fv
from caselight.operators.filters import classify_field
from caselight.plans.mart import Mart

PROFILE = ["field", "kind", "min", "max", "distinct_values"]


def _literal_rows(df: DataFrame, rows: list[tuple[str, int, str]]) -> DataFrame:
    values = ", ".join(f"('{f}', {i}, '{v}')" for f, i, v in rows)
    return df.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(field, pos, value)")


def string_values(mart: Mart) -> DataFrame:
    """Distinct non-blank (field, value) of every text field, in one scan of the cases."""
    cells = [c for f in fv.STRING_FIELDS for c in (F.lit(f), F.col(f))]
    return (
        mart.reports.select(F.stack(F.lit(len(fv.STRING_FIELDS)), *cells).alias("field", "value"))
        .filter("value <> ''")
        .distinct()
    )


def number_values(mart: Mart) -> DataFrame:
    """Distinct (field, value) of every numeric field, in one scan of the cases."""
    cells = [c for f in fv.NUMBER_FIELDS for c in (F.lit(f), F.col(f).cast("double"))]
    return (
        mart.reports.select(F.stack(F.lit(len(fv.NUMBER_FIELDS)), *cells).alias("field", "value"))
        .filter("value IS NOT NULL")
        .distinct()
    )


def member_values(mart: Mart) -> DataFrame:
    """Distinct vaccine types and manufacturers."""
    types = mart.reports.select(F.lit("VAX_TYPES").alias("field"), F.explode("VAX_TYPES").alias("value"))
    makers = mart.reports_vax.select(F.lit("VAX_MANU").alias("field"), F.col("VAX_MANU").alias("value"))
    return types.unionByName(makers).filter("value <> ''").distinct()


def field_profiles(mart: Mart) -> DataFrame:
    """One row per filterable field: its kind, and range or number of distinct values.

    Distinct values are found first (map-side combined), then summarised per field, so exact
    distinct counts of many fields cost one pass instead of one expansion each.
    """
    empty = F.lit(None).cast("double")
    texts = string_values(mart).unionByName(member_values(mart)).groupBy("field").agg(
        F.count("*").alias("distinct_values")
    )
    unlimited = F.col("field").isin("VAX_TYPES", "VAX_MANU")
    kind = F.when(unlimited | (F.col("distinct_values") <= fv.ENUM_VALUE_LIMIT), "enum").otherwise("text")
    texts = texts.select("field", kind.alias("kind"), empty.alias("min"), empty.alias("max"), "distinct_values")
    numbers = number_values(mart).groupBy("field").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("distinct_values")
    ).withColumn("kind", F.lit("numeric"))
    fixed = {
        "REACTIONS": ("enum", len(fv.REACTIONS)),
        "HAS_DATA": ("enum", len(fv.HISTORY_FIELDS)),
        "IS_DOMESTIC": ("enum", 2),
    }
    values = ", ".join(f"('{f}', '{k}', {n}L)" for f, (k, n) in fixed.items())
    static = mart.spark.sql(
        "SELECT field, kind, CAST(NULL AS double) AS min, CAST(NULL AS double) AS max, "
        f"distinct_values FROM VALUES {values} AS t(field, kind, distinct_values)"
    )
    terms = mart.symptom_bg.agg(F.count("*").alias("distinct_values")).select(
        F.lit("SYMPTOMS").alias("field"), F.lit("text").alias("kind"),
        empty.alias("min"), empty.alias("max"), "distinct_values",
    )
    # fields without a value have a row as well
    unseen = ", ".join(
        f"('{f}', '{k}')" for k, fields in (("enum", [*fv.STRING_FIELDS, "VAX_TYPES", "VAX_MANU"]),
                                            ("numeric", fv.NUMBER_FIELDS)) for f in fields)
    every = mart.spark.sql(f"SELECT field, kind AS usual FROM VALUES {unseen} AS t(field, kind)")
    seen = texts.unionByName(numbers.select(*PROFILE))
    found = every.join(seen, "field", "left").select(
        "field", F.coalesce("kind", "usual").alias("kind"), "min", "max",
        F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"))
    return reduce(DataFrame.unionByName, [found, static, terms]).orderBy("field")


def _first_values(values: DataFrame, order: str, limit: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("field").orderBy(order))
    return values.withColumn("pos", place).filter(F.col("pos") <= limit)


def _few(values: DataFrame, limit: int) -> DataFrame:
    """Fields with no more than ``limit`` values, decided without sorting any field.

    Counts come from a plain aggregate; only fields that pass are numbered.
    """
    passing = values.groupBy("field").agg(F.count("*").alias("n")).filter(F.col("n") <= limit)
    return values.join(passing.select("field"), "field", "left_semi")


def field_values(mart: Mart) -> DataFrame:
    """(field, pos, value) offered for selection: every value of the enumerable fields, the
    values of low-cardinality numbers, and the most reported terms as suggestions."""
    texts = _first_values(_few(string_values(mart), fv.ENUM_VALUE_LIMIT), "value", fv.ENUM_VALUE_LIMIT)
    members = member_values(mart)
    in_order = F.row_number().over(Window.partitionBy("field").orderBy("value"))
    types = members.filter("field = 'VAX_TYPES'").withColumn("pos", in_order)
    # manufacturers are all offered; they are sorted by the reader, as range-partitioned output
    makers = members.filter("field = 'VAX_MANU'").withColumn("pos", F.lit(None).cast("int"))
    few = _few(number_values(mart), fv.NUMERIC_VALUE_LIMIT)
    few = few.withColumn("value", F.rint("value").cast("bigint")).distinct()
    numbers = _first_values(few, "value", fv.NUMERIC_VALUE_LIMIT).withColumn("value", F.col("value").cast("string"))
    terms = term_suggestions(mart).select(
        F.lit("SYMPTOMS").alias("field"), "pos", F.col("SYMPTOM").alias("value")
    )
    static = _literal_rows(
        mart.reports,
        [("REACTIONS", i, v) for i, v in enumerate(fv.REACTION_CHOICES, 1)]
        + [("HAS_DATA", i, v) for i, v in enumerate(fv.HISTORY_FIELDS, 1)]
        + [("IS_DOMESTIC", 1, "true"), ("IS_DOMESTIC", 2, "false")],
    )
    frames = [f.select("field", "pos", "value") for f in (texts, types, makers, numbers, terms, static)]
    return reduce(DataFrame.unionByName, frames).orderBy("field", "pos", "value")


def term_suggestions(mart: Mart, limit: int = fv.TERM_SUGGESTIONS) -> DataFrame:
    top = (
        mart.symptom_bg.join(mart.symptoms, "SYMPTOM_ID")
        .orderBy(F.desc("bg_n"), F.asc("SYMPTOM"))
        .limit(limit)
    )
    # at most ``limit`` rows reach this window
    return top.select(
        F.row_number().over(Window.orderBy(F.desc("bg_n"), F.asc("SYMPTOM"))).alias("pos"), "SYMPTOM"
    )


def describe_field(mart: Mart, name: str) -> tuple[DataFrame, DataFrame]:
    """Profile row and offered values of one field."""
    if classify_field(name) is None:
        raise ValueError("field not filterable")
    wanted = F.col("field") == name.upper()
    return field_profiles(mart).filter(wanted), field_values(mart).filter(wanted)


def vaccine_types(mart: Mart, limit: int | None = fv.VAX_TYPE_LIMIT, containing: str = "") -> DataFrame:
    """Vaccine types by number of distinct cases, cases without a report included: of those that contain
    a text (any case) the ``limit`` most frequent, or all."""
    types = mart.reports_vax.select(fv.CASE_ID, "VAX_TYPE")
    text = containing.strip().upper()
    if text:
        types = types.filter(F.upper("VAX_TYPE").contains(text))
    counted = types.distinct().groupBy("VAX_TYPE").agg(F.count("*").alias("cases")).orderBy(
        F.desc("cases"), F.asc("VAX_TYPE"))
    return counted if limit is None else counted.limit(limit)


def vaccine_type_choices(mart: Mart, containing: str = "", limit: int | None = None) -> DataFrame:
    """The type picker: alphabetical, narrowed to types containing a text (any case)."""
    return vaccine_types(mart, limit, containing).select("VAX_TYPE").orderBy("VAX_TYPE")


def status(mart: Mart) -> DataFrame:
    """Row counts of the two main tables."""
    reports = mart.reports.agg(F.count("*")).scalar()
    vaccine_rows = mart.reports_vax.agg(F.count("*")).scalar()
    return mart.spark.range(1).select(reports.alias("records"), vaccine_rows.alias("vax_rows"))
