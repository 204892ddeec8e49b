"""Raw tables -> case model, as DataFrame-to-DataFrame steps.

Grain: ``reports`` holds one row per case (its primary submission). Every step narrows and
pre-aggregates before it shuffles, so a case or a term that owns a third of the raw rows
arrives at the exchange as a handful of partial rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caselight import fixed_values as fv
from caselight.functions.derive import is_followup, is_primary, onset_delay, surviving_history
from caselight.functions.text import trim_spaces

CASE_ID = fv.CASE_ID
COMBO_SEPARATOR = "::"
RANGE_TERMS = 4096
MOST_CUTS = 10_000
DICTIONARY_SALTS = 16
DICTIONARY_BROADCAST_BYTES = 64 << 20


def _typed() -> Column:
    return F.col("VAX_TYPE").isNotNull() & (F.col("VAX_TYPE") != "")


def _primary(df: DataFrame) -> DataFrame:
    return df.filter(is_primary(F.col("REPORT_ORDER")))


def vax_details(vaccines: DataFrame, partitions: int | None = None) -> DataFrame:
    """Distinct vaccine attributes per case (primary submissions) and their number of rows.

    The one pass over the raw vaccine rows: everything else about vaccines is read from here,
    case by case, without another exchange. With ``partitions`` rows meet in that many by case, where they are counted:
    hardly two rows of a task are alike, so counting them there first would only fill its memory.
    """
    attributes = [CASE_ID, "VAX_TYPE", "VAX_MANU", "VAX_ROUTE", "VAX_SITE", "VAX_DOSE_SERIES", "VAX_LOT"]
    rows = _primary(vaccines).select(attributes)
    if partitions:
        rows = rows.repartition(partitions, CASE_ID)
    return rows.groupBy(*attributes).agg(F.count("*").alias("VAX_ROWS"))


def vaccine_rollup(vax_details: DataFrame) -> DataFrame:
    """Per case: vaccine rows of the primary submission and its sorted set of types."""
    return vax_details.groupBy(CASE_ID).agg(
        F.sum("VAX_ROWS").alias("NUM_VAX"),
        F.array_sort(F.collect_set(F.when(_typed(), F.col("VAX_TYPE")))).alias("VAX_TYPES"),
    )


def followup_counts(submissions: DataFrame) -> DataFrame:
    return (
        submissions.filter(is_followup(F.col("REPORT_ORDER")))
        .groupBy(CASE_ID)
        .agg(F.count("*").alias("FOLLOWUP_COUNT"))
    )


def reports(submissions: DataFrame, vax_details: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per case. Both rollups join on the key the primaries are partitioned by, so
    the wide narrative rows move once."""
    primaries = _primary(submissions)
    if partitions:
        primaries = primaries.repartition(partitions, CASE_ID)
    types = F.coalesce(F.col("VAX_TYPES"), F.array().cast("array<string>"))
    return (
        primaries.join(vaccine_rollup(vax_details), CASE_ID, "left")
        .join(followup_counts(submissions), CASE_ID, "left")
        .select(
            CASE_ID, "RECVDATE", "VAX_DATE", "ONSET_DATE", "DATEDIED", "AGE_YRS", "STATE", "SEX",
            "SYMPTOM_TEXT",
            onset_delay(F.col("NUMDAYS"), F.col("VAX_DATE"), F.col("ONSET_DATE")).alias("NUMDAYS"),
            *fv.OUTCOME_FLAGS,
            "IS_DOMESTIC",
            F.coalesce("FOLLOWUP_COUNT", F.lit(0)).alias("FOLLOWUP_COUNT"),
            F.coalesce("NUM_VAX", F.lit(0)).alias("NUM_VAX"),
            types.alias("VAX_TYPES"),
            F.nullif(F.array_join(types, COMBO_SEPARATOR), F.lit("")).alias("VAX_COMBO"),
            surviving_history().alias("HAS_DATA"),
        )
    )


def reports_vax(vax_details: DataFrame) -> DataFrame:
    """Distinct (case, type, manufacturer) of primary submissions, typed rows only.

    Not restricted to cases in ``reports``.
    """
    return vax_details.filter(_typed()).select(CASE_ID, "VAX_TYPE", "VAX_MANU").distinct()


def term_lines(terms: DataFrame, *keep: str) -> DataFrame:
    """The five term columns as rows: ``keep`` columns plus a trimmed, non-blank SYMPTOM."""
    wide = F.array(*[trim_spaces(F.col(f"SYMPTOM{i}")) for i in range(1, 6)])
    return terms.select(*keep, F.explode(wide).alias("SYMPTOM")).filter("SYMPTOM <> ''")


def vocabulary(terms: DataFrame) -> DataFrame:
    """Distinct terms over every submission, follow-ups included."""
    return term_lines(terms).distinct()


def term_counts(terms: DataFrame) -> DataFrame:
    """Lines of each term over every submission; what a later load adds or takes away is added or subtracted here."""
    return term_lines(terms).groupBy("SYMPTOM").agg(F.count("*").alias("lines"))


def symptoms(vocabulary: DataFrame, cuts: int | None = None) -> DataFrame:
    """Dictionary with dense ids 1..N in alphabetical (binary) order.

    The order is cut into ranges at a content-chosen sample of terms (those with the lowest
    hashes), one for about ``RANGE_TERMS`` terms; a term finds its range by halving. Ranges are
    numbered one by one and shifted by the sizes of those before. Equal input gives equal ids
    whatever the number of cuts, and no task sorts the whole vocabulary.
    """
    if cuts is None:
        cuts = min(MOST_CUTS, vocabulary.count() // RANGE_TERMS + 1)
    chosen = (
        vocabulary.orderBy(F.xxhash64("SYMPTOM"), "SYMPTOM")
        .limit(cuts)
        .agg(F.array_sort(F.collect_list("SYMPTOM")))
        .scalar()
    )
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(cuts.bit_length()))])

    def halve(passed: Column, step: Column) -> Column:
        # beyond the last cut there is none to compare with
        return F.when(F.get("cuts", passed + step - 1) <= F.col("SYMPTOM"), passed + step).otherwise(passed)

    located = vocabulary.withColumn("cuts", chosen).select("SYMPTOM", F.aggregate(steps, F.lit(0), halve).alias("part"))
    # at most MOST_CUTS + 1 rows, so the running total may sit in one task
    before = located.groupBy("part").agg(F.count("*").alias("n")).select(
        "part",
        (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("terms_before"),
    )
    within = F.row_number().over(Window.partitionBy("part").orderBy("SYMPTOM"))
    return (
        located.withColumn("rank", within)
        .join(before, "part")
        .select((F.col("terms_before") + F.col("rank")).cast("int").alias("SYMPTOM_ID"), "SYMPTOM")
    )


def dictionary_is_small(symptoms: DataFrame) -> bool:
    """Measured, not assumed: whether the dictionary text fits a broadcast."""
    size = symptoms.agg(F.sum(F.octet_length("SYMPTOM") + 32)).first()[0] or 0
    return size <= DICTIONARY_BROADCAST_BYTES


def reports_symptoms(
    terms: DataFrame, symptoms: DataFrame, reports: DataFrame, small_dictionary: bool, partitions: int | None = None
) -> DataFrame:
    """Distinct (case, term id) of primary submissions whose case is in ``reports``.

    With ``partitions`` and a small dictionary the rows meet in that many by case before their terms become rows.
    """
    rows = _primary(terms)
    if partitions and small_dictionary:
        rows = rows.select(CASE_ID, *[f"SYMPTOM{i}" for i in range(1, 6)]).repartition(partitions, CASE_ID)
    lines = term_lines(rows, CASE_ID)
    if small_dictionary:
        pairs = lines.join(F.broadcast(symptoms), "SYMPTOM")
    else:
        # a popular term is spread over DICTIONARY_SALTS partitions, its one dictionary row copied
        salts = F.explode(F.sequence(F.lit(0), F.lit(DICTIONARY_SALTS - 1)))
        salt = F.pmod(F.xxhash64(CASE_ID), F.lit(DICTIONARY_SALTS)).cast("int")
        pairs = (
            lines.distinct()
            .withColumn("salt", salt)
            .join(symptoms.withColumn("salt", salts), ["SYMPTOM", "salt"])
        )
    return (
        pairs.select(CASE_ID, "SYMPTOM_ID")
        .distinct()
        .join(reports.select(CASE_ID), CASE_ID, "left_semi")
    )


def symptom_bg(reports_symptoms: DataFrame) -> DataFrame:
    return reports_symptoms.groupBy("SYMPTOM_ID").agg(F.count("*").alias("bg_n"))


# --- postings: the cases of a label, filed by the label ----------------------------------------

POSTING_PARTS = 64


def posting_part(label: Column, parts: int = POSTING_PARTS) -> Column:
    """The folder of a label's postings; of a literal it is a constant, which prunes the scan."""
    return F.pmod(F.xxhash64(label), F.lit(parts)).cast("int")


def term_cases(reports_symptoms: DataFrame, symptoms: DataFrame, small_dictionary: bool) -> DataFrame:
    """Distinct (lower-cased term, case): every spelling of a term files under one label."""
    spelled = symptoms.select("SYMPTOM_ID", F.lower("SYMPTOM").alias("TERM"))
    pairs = reports_symptoms.join(F.broadcast(spelled) if small_dictionary else spelled, "SYMPTOM_ID")
    return pairs.select("TERM", CASE_ID).distinct().withColumn("part", posting_part(F.col("TERM")))


def manu_cases(reports_vax: DataFrame) -> DataFrame:
    """Distinct (manufacturer, case) of typed vaccines."""
    named = reports_vax.filter(F.col("VAX_MANU").isNotNull()).select("VAX_MANU", CASE_ID).distinct()
    return named.withColumn("part", posting_part(F.col("VAX_MANU")))


def narrative_grams(reports: DataFrame, buckets: int) -> DataFrame:
    """Distinct (three characters of a lower-cased narrative, bucket of the case)."""
    text = F.lower("SYMPTOM_TEXT")
    grams = F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1))
    found = reports.filter(F.length("SYMPTOM_TEXT") > 2).select(
        F.pmod(F.hash(CASE_ID), F.lit(buckets)).alias("BUCKET"), F.explode(F.array_distinct(grams)).alias("GRAM"))
    return found.select("GRAM", "BUCKET").distinct().withColumn("part", posting_part(F.col("GRAM")))
