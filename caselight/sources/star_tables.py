"""The three raw tables, derived from an order/line-item star schema.

Clean star-schema rows carry no NULLs, blanks, junk or follow-ups, so those are introduced
deterministically from the keys. Every source row takes part: each order is a case, each
line item a vaccine row and a term row, each document the narrative of the case with its id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight import fixed_values as fv


@dataclass(frozen=True)
class RawTables:
    """Bronze-shaped inputs of the case model."""

    submissions: DataFrame
    vaccines: DataFrame
    terms: DataFrame


#: A Parquet table of more bytes has several row groups, so that several tasks read it.
SPREAD_BYTES = 128 << 20


def raw_tables(spark: SparkSession, folder: str, buckets: int | None = None) -> RawTables:
    """The raw tables; with ``buckets``, submissions meet their narratives in that many partitions by case."""
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    lines = spread(read("lineitem"))
    return RawTables(
        submissions=_submissions(
            spread(read("orders")), read("customer"), read("nation"), read("documents"), buckets
        ),
        vaccines=_vaccines(lines, read("part")),
        terms=_terms(lines, read("part"), read("supplier")),
    )


def spread(table: DataFrame) -> DataFrame:
    """Deal rows to all cores when a small table has fewer files than there are cores.

    A file of one row group is read by one task, which would then also do all the work after
    the scan. Tables of many files or row groups, the case at scale, are left as they are.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    if len(table.inputFiles()) >= cores or scan_bytes(table) > SPREAD_BYTES:
        return table
    return table.repartition(cores)


def scan_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, as the scans report them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def padded_id(key: Column) -> Column:
    """Seven digits, zero padded; longer keys are kept whole."""
    text = key.cast("string")
    return F.when(key < 10_000_000, F.lpad(text, 7, "0")).otherwise(text)


def _line_no(number: Column) -> Column:
    return (number % 2_000_000_000).cast("int")


def _submissions(
    orders: DataFrame, customer: DataFrame, nation: DataFrame, documents: DataFrame, buckets: int | None = None
) -> DataFrame:
    k = F.col("o_orderkey")
    n = F.col("n")

    def every(step: int) -> Column:
        return k % step == 0

    def yes(condition: Column, otherwise: str | None = None) -> Column:
        flag = F.when(condition, "Y")
        return flag if otherwise is None else flag.otherwise(otherwise)

    people = customer.select("c_custkey", "c_nationkey", "c_mktsegment").join(
        nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    ordered = F.col("o_orderdate").cast("date")
    received = F.date_add(ordered, (k % 900 - 20).cast("int"))
    age = F.when(~every(13), ((k * 7) % 1000).cast("double") / 10.0)
    submissions_per_case = F.when(every(60), 3).when(every(20), 2).otherwise(1)
    order = n + F.when(every(211), 1).otherwise(0)
    domestic = ~every(7)

    known = orders.join(people, F.col("o_custkey") == F.col("c_custkey"))
    texts = documents.select("doc_id", "text")
    submissions_of = F.explode(F.sequence(F.lit(1), submissions_per_case)).alias("n")
    if buckets is None:
        told = known.join(texts, k == F.col("doc_id"), "left").select("*", padded_id(k).alias(fv.CASE_ID), submissions_of)
    else:
        # by the case id, so that what follows by case moves no narrative again; a join right above two exchanges would
        # have them all over again in spark.sql.shuffle.partitions
        known = known.withColumn(fv.CASE_ID, padded_id(k)).repartition(buckets, fv.CASE_ID).select("*", submissions_of)
        texts = texts.withColumn("_case", padded_id(F.col("doc_id"))).repartition(buckets, "_case")
        same = (F.col(fv.CASE_ID) == F.col("_case")) & (k - F.col("doc_id") == 0)
        told = known.join(texts, same, "left")

    return (
        told.select(
            fv.CASE_ID,
            received.alias("RECVDATE"),
            F.col("n_name").alias("STATE"),
            age.alias("AGE_YRS"),
            F.floor(age).cast("double").alias("CAGE_YR"),
            F.lit(None).cast("double").alias("CAGE_MO"),
            F.when(F.col("o_orderstatus") == "F", "F")
            .when(F.col("o_orderstatus") == "O", "M")
            .when(every(2), "")
            .alias("SEX"),
            F.lit(None).cast("date").alias("RPT_DATE"),
            F.col("text").alias("SYMPTOM_TEXT"),
            yes(every(50)).alias("DIED"),
            F.when(every(100), F.date_add(ordered, (k % 25).cast("int"))).alias("DATEDIED"),
            yes(every(40), "").alias("L_THREAT"),
            yes(every(12)).alias("ER_VISIT"),
            yes(every(8)).alias("HOSPITAL"),
            F.when(every(8), (k % 14).cast("int")).alias("HOSPDAYS"),
            yes(every(90), "").alias("X_STAY"),
            yes(every(33)).alias("DISABLE"),
            F.when(every(31), None).when(every(3), "N").otherwise("Y").alias("RECOVD"),
            F.when(~every(9), ordered).alias("VAX_DATE"),
            F.when(~every(5), F.date_add(ordered, (k % 40 - 3).cast("int"))).alias("ONSET_DATE"),
            F.when(every(101), 20000).when(every(4), (k % 30).cast("int")).alias("NUMDAYS"),
            F.when(every(12), "see text").otherwise("N/A").alias("LAB_DATA"),
            F.when(every(23), "").otherwise(F.col("o_orderpriority")).alias("V_ADMINBY"),
            F.when(~every(29), F.col("c_mktsegment")).alias("V_FUNDBY"),
            F.when(k % 4 == 0, "None.").when(k % 4 == 1, "NKA").when(k % 4 == 2, F.col("n_name"))
            .otherwise(" unknown ").alias("OTHER_MEDS"),
            F.when(every(10), F.col("c_mktsegment")).otherwise("No").alias("CUR_ILL"),
            F.when(k % 6 == 0, " None ").when(k % 6 == 1, "none known").when(k % 6 == 2, "")
            .when(k % 6 == 4, "N/A").when(k % 6 == 5, F.col("c_mktsegment")).alias("HISTORY"),
            F.lit("").alias("PRIOR_VAX"),
            F.concat(F.lit("SP"), (k % 1000).cast("string")).alias("SPLTTYPE"),
            F.lit("2").alias("FORM_VERS"),
            F.date_add(received, 1).alias("TODAYS_DATE"),
            yes(every(500)).alias("BIRTH_DEFECT"),
            yes(k % 4 == 1).alias("OFC_VISIT"),
            yes(k % 6 == 1).alias("ER_ED_VISIT"),
            F.when(k % 7 == 0, "NKDA").when(k % 7 == 1, "no known allergies")
            .when(k % 7 == 2, "Penicillin").when(k % 7 == 3, "unknown.").alias("ALLERGIES"),
            F.when((k % 10 != 1) | (order > 1), order).cast("int").alias("REPORT_ORDER"),
            domestic.alias("IS_DOMESTIC"),
            F.when(domestic, F.concat(F.year(ordered).cast("string"), F.lit("DATA.CSV")))
            .otherwise("NONDOMESTICDATA.CSV").alias("FILE_NAME"),
            _line_no(k * 3 + n).alias("FILE_LINE_NO"),
        )
    )


def _line_metadata(role: str) -> list[Column]:
    domestic = F.col("l_orderkey") % 7 != 0
    return [
        domestic.alias("IS_DOMESTIC"),
        F.when(domestic, F.concat(F.year("l_shipdate").cast("string"), F.lit(f"{role}.CSV")))
        .otherwise(f"NONDOMESTIC{role}.CSV").alias("FILE_NAME"),
        _line_no(
            F.col("l_partkey") * 700 + F.col("l_suppkey") * 7 + F.col("l_linenumber") - 1
        ).alias("FILE_LINE_NO"),
    ]


def _vaccines(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    p = F.col("l_partkey")
    line = F.col("l_linenumber")
    return lineitem.join(
        part.select("p_partkey", "p_name", "p_brand", "p_type"), p == F.col("p_partkey")
    ).select(
        padded_id(F.col("l_orderkey")).alias(fv.CASE_ID),
        F.when(p % 17 == 0, "").otherwise(F.col("p_type")).alias("VAX_TYPE"),
        F.when(p % 31 != 0, F.col("p_brand")).alias("VAX_MANU"),
        F.when(p % 19 == 0, "UNK").when(p % 23 == 0, " Unknown ").when(p % 29 == 0, None)
        .otherwise(F.col("p_name")).alias("VAX_LOT"),
        F.when(line != 6, line.cast("string")).otherwise(" ").alias("VAX_DOSE_SERIES"),
        F.col("l_returnflag").alias("VAX_ROUTE"),
        F.when(p % 37 != 0, F.col("l_linestatus")).alias("VAX_SITE"),
        F.concat_ws(" ", "p_type", "p_brand").alias("VAX_NAME"),
        F.when(line == 7, 2).when(line != 1, 1).cast("int").alias("REPORT_ORDER"),
        *_line_metadata("VAX"),
    )


def _terms(lineitem: DataFrame, part: DataFrame, supplier: DataFrame) -> DataFrame:
    p = F.col("l_partkey")
    line = F.col("l_linenumber")
    case_id = padded_id(F.col("l_orderkey"))
    version = F.lit("23.1")
    return (
        lineitem.join(part.select("p_partkey", "p_name", "p_brand", "p_type"), p == F.col("p_partkey"))
        .join(supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.when(p % 97 == 0, F.concat(F.lit("T"), case_id)).otherwise(case_id).alias(fv.CASE_ID),
            F.when(line == 5, F.upper("p_name")).otherwise(F.col("p_name")).alias("SYMPTOM1"),
            version.alias("SYMPTOMVERSION1"),
            F.concat(F.lit(" "), "p_brand", F.lit(" ")).alias("SYMPTOM2"),
            version.alias("SYMPTOMVERSION2"),
            F.col("s_name").alias("SYMPTOM3"),
            version.alias("SYMPTOMVERSION3"),
            F.when(line == 3, F.col("p_type")).otherwise("").alias("SYMPTOM4"),
            version.alias("SYMPTOMVERSION4"),
            F.lit(None).cast("string").alias("SYMPTOM5"),
            F.lit(None).cast("string").alias("SYMPTOMVERSION5"),
            F.when(line == 7, 2).otherwise(1).cast("int").alias("REPORT_ORDER"),
            *_line_metadata("SYMPTOMS"),
        )
    )
