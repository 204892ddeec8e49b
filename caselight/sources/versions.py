"""Versions of the bronze tables: which feed files they hold, and which run wrote each file's rows.

A run writes its rows to a folder of its own (``<table>/run=<id>/FILE_NAME=<name>``) and then a manifest, one row
per table and file. Only its number in the ``versions`` log, written last, makes it the version that readers see. A run
that dies at any point before leaves the earlier version as it was, also where it had written some of its tables.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from caselight import fixed_values as fv
from caselight.session import WRITTEN, remove_folder, side_by_side
from caselight.sources.feed import TABLE_COLUMNS, FeedError

MANIFEST = "table_name string, file_name string, run string, rows bigint, key_digest decimal(38,0)"
LOG = "number bigint, run string, published_at timestamp"
KEY = [fv.CASE_ID, "FILE_NAME", "FILE_LINE_NO"]
#: Lines of a file whose numbers span so many times their number at most are told apart by bits.
MOST_APART = 8


@dataclass(frozen=True)
class Version:
    number: int
    run: str


def versions(spark: SparkSession, bronze: str) -> list[Version]:
    """The published versions, oldest first."""
    try:
        rows = spark.read.schema(LOG).parquet(f"{bronze}/versions").collect()
    except AnalysisException:
        return []
    first: dict[int, str] = {}
    for row in rows:  # of two runs that took one number, the same one wins for every reader
        first[row.number] = min(row.run, first.get(row.number, row.run))
    return [Version(n, first[n]) for n in sorted(first)]


def latest(spark: SparkSession, bronze: str) -> Version | None:
    found = versions(spark, bronze)
    return found[-1] if found else None


def version_of(spark: SparkSession, bronze: str, number: int | None = None) -> Version:
    """The version of a number, or the latest one."""
    found = [v for v in versions(spark, bronze) if number is None or v.number == number]
    if not found:
        raise FeedError(f"no version {'' if number is None else number} in {bronze}")
    return found[-1]


def manifest(spark: SparkSession, bronze: str, version: Version | None) -> DataFrame:
    """(table_name, file_name, run, rows, key_digest): the files of a version; none without one."""
    if version is None:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{bronze}/manifests/{version.run}")


def file_keys(rows: DataFrame, table: str, run: str) -> DataFrame:
    """Manifest rows of newly written rows, with the number of keys (id, file, line) that occur more than once.

    The digest is a sum of key hashes, so it does not depend on order and tells repeated keys. Keys are exchanged only
    if some line of a file may come again, or if lines lie too far apart to be told by bits.
    """
    told = [F.lit(table).alias("table_name"), "file_name", F.lit(run).alias("run"), "rows", "key_digest", "repeated"]
    name = F.col("FILE_NAME").alias("file_name")
    if _lines_differ(rows):
        return rows.groupBy(name).agg(
            F.count("*").alias("rows"), F.sum(F.xxhash64(*KEY).cast("decimal(20,0)")).cast("decimal(38,0)").alias("key_digest"),
        ).withColumn("repeated", F.lit(0).cast("bigint")).select(*told)
    keys = rows.groupBy(*KEY).agg(F.count("*").alias("n"))
    return keys.groupBy(name).agg(
        F.sum("n").alias("rows"),
        F.sum(F.xxhash64(*KEY).cast("decimal(20,0)") * F.col("n")).cast("decimal(38,0)").alias("key_digest"),
        F.count_if(F.col("n") > 1).alias("repeated"),
    ).select(*told)


def _lines_differ(rows: DataFrame) -> bool:
    """Whether no line number comes twice in a file, as far as a bit for each line tells; then no key does."""
    line = F.col("FILE_LINE_NO").cast("bigint")
    spans = rows.groupBy("FILE_NAME").agg(F.count("*").alias("n"), (F.max(line) - F.min(line)).alias("span"))
    found = spans.agg(F.sum("n").alias("rows"), F.bool_and(F.col("span") < MOST_APART * F.col("n")).alias("near")).first()
    if not found.near:  # no rows, no line numbers, or few lines for their span
        return False
    bits = rows.groupBy("FILE_NAME", F.bitmap_bucket_number(line).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(line)).alias("lines"))
    return bits.agg(F.sum(F.bitmap_count("lines"))).first()[0] == found.rows


def merged(before: DataFrame, fresh: DataFrame) -> DataFrame:
    """The files of ``before`` that ``fresh`` does not bring anew, and those of ``fresh``."""
    return before.join(fresh, ["table_name", "file_name"], "left_anti").select(fresh.columns).unionByName(fresh)


def publish(spark: SparkSession, bronze: str, base: Version | None, run: str, files: DataFrame) -> Version:
    """Make ``files`` (manifest rows) the version after ``base``, which must still be the latest."""
    files.coalesce(1).write.parquet(f"{bronze}/manifests/{run}")
    mine = Version(base.number + 1 if base else 1, run)
    if latest(spark, bronze) != base:
        raise FeedError(f"another run published while {run} worked on version {mine.number}")
    spark.range(1).select(
        F.lit(mine.number).cast("bigint").alias("number"), F.lit(run).alias("run"),
        F.current_timestamp().alias("published_at"),
    ).write.mode("append").parquet(f"{bronze}/versions")
    if mine not in versions(spark, bronze):
        raise FeedError(f"another run published version {mine.number}")
    return mine


def add_tables(spark: SparkSession, bronze: str, tables: dict[str, DataFrame], append: bool = True) -> Version:
    """Publish rows that are typed already (bronze columns, by table) as files of a new version."""
    base = latest(spark, bronze)
    run = uuid.uuid4().hex

    def write(table: str) -> list[Row]:
        columns = [*TABLE_COLUMNS[table], *fv.METADATA_COLUMNS]
        tables[table].select(*columns).withColumn("run", F.lit(run)).write.mode("append").options(
            **WRITTEN).partitionBy("run", "FILE_NAME").parquet(f"{bronze}/{table}")
        written = spark.read.schema(
            f"{', '.join(f'{c} {bronze_type(c)}' for c in columns)}, run string"
        ).option("basePath", f"{bronze}/{table}").parquet(f"{bronze}/{table}/run={run}")
        return file_keys(written, table, run).collect()  # one row a file

    fresh = [row for rows in side_by_side(spark, write, tables) for row in rows]
    repeated = [f"{r.table_name} of {r.file_name}: {r.repeated}" for r in fresh if r.repeated]
    if repeated:
        raise FeedError(f"repeated keys (case, file, line) in {'; '.join(repeated)}")
    files = spark.createDataFrame([tuple(r)[:5] for r in fresh], MANIFEST)
    return publish(spark, bronze, base, run, merged(manifest(spark, bronze, base), files) if append else files)


def changed_files(spark: SparkSession, bronze: str, old: Version | None, new: Version) -> tuple[DataFrame, DataFrame]:
    """Manifest rows of the files that only ``old`` holds that way, and of those that only ``new`` does."""
    before, after = manifest(spark, bronze, old), manifest(spark, bronze, new)
    where = ["table_name", "file_name", "run"]
    return before.join(after, where, "left_anti"), after.join(before, where, "left_anti")


def bronze_type(column: str) -> str:
    if column in fv.DATE_COLUMNS:
        return "date"
    if column in fv.DOUBLE_COLUMNS:
        return "double"
    if column in fv.INTEGER_COLUMNS + ["REPORT_ORDER", "FILE_LINE_NO"]:
        return "int"
    return "boolean" if column == "IS_DOMESTIC" else "string"


def rows_of(spark: SparkSession, bronze: str, table: str, files: DataFrame) -> DataFrame:
    """The rows of some manifest rows of one table; the scan lists their runs and prunes to their files."""
    columns = [*TABLE_COLUMNS[table], *fv.METADATA_COLUMNS]
    # an explicit schema: partition values stay text, and nothing is inferred
    schema = ", ".join(f"{c} {bronze_type(c)}" for c in columns)
    names: dict[str, list[str]] = {}
    for row in files.where(F.col("table_name") == table).select("run", "file_name").collect():  # one row a file
        names.setdefault(row.run, []).append(row.file_name)
    if not names:
        return spark.createDataFrame([], schema)
    held = F.lit(False)
    for run, of_run in names.items():
        held = held | ((F.col("run") == run) & F.col("FILE_NAME").isin(of_run))
    root = f"{bronze}/{table}"
    rows = spark.read.schema(f"{schema}, run string").option("basePath", root).parquet(*[f"{root}/run={r}" for r in names])
    return rows.where(held).select(*columns)


def altered_files(spark: SparkSession, bronze: str, version: Version) -> DataFrame:
    """Files of a version whose stored rows do not have the number and the keys of the manifest."""
    files = manifest(spark, bronze, version)
    found = None
    for table in TABLE_COLUMNS:
        keys = file_keys(rows_of(spark, bronze, table, files), table, version.run).drop("run", "repeated")
        found = keys if found is None else found.unionByName(keys)
    as_told = files.select("table_name", "file_name", F.col("rows").alias("_rows"), F.col("key_digest").alias("_digest"))
    same = (F.col("rows") == F.col("_rows")) & (F.col("key_digest") == F.col("_digest"))
    return as_told.join(found, ["table_name", "file_name"], "left").where(~F.coalesce(same, F.lit(False))).select(
        "table_name", "file_name", F.col("_rows").alias("rows_told"), F.coalesce("rows", F.lit(0)).alias("rows_found"))


def remove_unused(spark: SparkSession, bronze: str, keep: int = 2) -> list[str]:
    """Remove the folders of runs that none of the last ``keep`` versions refers to; returns their runs.

    Not for use while a run writes: its folders are unused until it publishes.
    """
    known = versions(spark, bronze)[-keep:]
    if not known:
        return []
    used = {row.run for v in known for row in manifest(spark, bronze, v).select("run").distinct().collect()}
    gone = set()
    for table in TABLE_COLUMNS:
        for run in _runs(spark, f"{bronze}/{table}") - used:
            remove_folder(spark, f"{bronze}/{table}/run={run}")
            gone.add(run)
    return sorted(gone)


def _runs(spark: SparkSession, folder: str) -> set[str]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where):
        return set()
    names = [status.getPath().getName() for status in system.listStatus(where)]
    return {n.removeprefix("run=") for n in names if n.startswith("run=")}
