"""Feed files -> typed bronze tables, with rejects, an audit trail and replace-by-file.

Layout under the bronze folder: ``submissions``, ``vaccines`` and ``terms`` by run and ``FILE_NAME``, the manifests
and the log of ``versions``; append-only ``import_summary``, ``rejects`` and ``unparseable`` tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caselight import fixed_values as fv
from caselight.session import WRITTEN, remove_folder, side_by_side
from caselight.sources import versions
from caselight.sources.feed import (
    NON_DOMESTIC, REJECTED, TABLE_COLUMNS, FeedError, FeedFile, header_of, list_feed,
    missing_columns, read_feed, require_distinct_names, split_missing,
)
from caselight.sources.star_tables import RawTables

NUMBERING_CHUNK = 100_000
BLOCK_SIZE = "spark.sql.files.maxPartitionBytes"
#: Blocks of a chosen size are read by tasks of about this many bytes, so small ones don't each need a task and a file.
TASK_BYTES = 64 << 20


@dataclass
class IngestReport:
    """What one run did, per file."""

    imported: dict[str, int] = field(default_factory=dict)
    rejected: dict[str, int] = field(default_factory=dict)
    unparseable: dict[tuple[str, str], int] = field(default_factory=dict)
    kept_existing: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)


def parsed_value(column: str) -> Column:
    """A text column in its bronze type; what does not parse becomes NULL."""
    text = F.col(column)
    if column in fv.DATE_COLUMNS:
        return F.try_to_date(text, fv.FEED_DATE_FORMAT)
    if column in fv.DOUBLE_COLUMNS:
        return text.try_cast("double")
    if column in fv.INTEGER_COLUMNS:
        return text.try_cast("int")
    return text


def typed(rows: DataFrame, table: str) -> DataFrame:
    """Accepted text rows -> bronze columns (all but the line number, which keeps its keys)."""
    order = F.lit(1)
    if fv.ORDER_COLUMN in rows.columns:
        order = F.coalesce(F.col(f"`{fv.ORDER_COLUMN}`").try_cast("int"), order)
    return rows.select(
        *[parsed_value(c).alias(c) for c in TABLE_COLUMNS[table]],
        order.alias("REPORT_ORDER"),
        (~F.startswith("FILE_NAME", F.lit(NON_DOMESTIC))).alias("IS_DOMESTIC"),
        "FILE_NAME", "path", "ordinal", "place",
    )


def unparseable_counts(rows: DataFrame, table: str) -> DataFrame:
    """(FILE_NAME, column, bad): values that are present but do not parse, in one aggregate."""
    columns = [
        c for c in TABLE_COLUMNS[table]
        if c in fv.DATE_COLUMNS + fv.DOUBLE_COLUMNS + fv.INTEGER_COLUMNS
    ]
    if not columns:
        return rows.sparkSession.createDataFrame([], "FILE_NAME string, column string, bad bigint")
    bad = [F.count_if(F.col(c).isNotNull() & parsed_value(c).isNull()).alias(c) for c in columns]
    cells = [x for c in columns for x in (F.lit(c), F.col(c))]
    return (
        rows.groupBy("FILE_NAME")
        .agg(*bad)
        .select("FILE_NAME", F.stack(F.lit(len(columns)), *cells).alias("column", "bad"))
        .filter("bad > 0")
    )


def number_lines(rows: DataFrame) -> DataFrame:
    """FILE_LINE_NO = place among the accepted rows of a file, without sorting a file in one task.

    Rows are numbered inside chunks of bounded size and shifted by the sizes of the chunks
    before; only chunk sizes are summed along a file. In a chunk whose records follow each other
    without a gap their numbers tell the place; only rows of the other chunks are shuffled and sorted.
    """
    chunk = ["FILE_NAME", "path", "chunk"]
    rows = rows.withColumn("chunk", F.floor(F.col("ordinal") / NUMBERING_CHUNK))
    along_file = Window.partitionBy("FILE_NAME").orderBy("path", "chunk")
    sizes = rows.groupBy(*chunk).agg(
        F.count("*").alias("n"), F.count("place").alias("placed"), F.min("place").alias("first"), F.max("place").alias("last"))
    before = sizes.select(
        *chunk, (F.sum("n").over(along_file) - F.col("n")).alias("lines_before"),
        F.when((F.col("placed") == F.col("n")) & (F.col("last") - F.col("first") + 1 == F.col("n")), F.col("first"))
        .alias("first"))
    # one row for each chunk of a (part) file
    whole = rows.join(F.broadcast(before.filter("first IS NOT NULL")), chunk).withColumn(
        "within", F.col("place") - F.col("first") + 1)
    gaps = before.filter("first IS NULL")
    if not gaps.isEmpty():
        within = F.row_number().over(Window.partitionBy(*chunk).orderBy("ordinal"))
        whole = whole.unionByName(rows.join(F.broadcast(gaps), chunk).withColumn("within", within))
    return whole.withColumn("FILE_LINE_NO", (F.col("lines_before") + F.col("within")).cast("int")).drop(
        "within", "lines_before", "first", "chunk", "path", "ordinal", "place")


def ingest(
    spark: SparkSession,
    source: str | Sequence[str] | Sequence[FeedFile],
    bronze: str,
    append: bool = False,
    prefix: str = "",
    block_bytes: int | None = None,
) -> IngestReport:
    """Load a folder, a list of named files, or chosen ``FeedFile``s, and publish the result as a new version.

    Every readable file is loaded even when others fail; a run with failures raises at its end, and a failed
    file has a row of no imported rows in ``import_summary``. A full load (not ``append``) replaces all three
    tables: one that no file brought anew is left empty. An ``append`` replaces the files it brings; a file that
    parsed to no rows leaves its stored rows alone. Readers see the earlier version until the last step; it stays if no
    file could be read, or if a key (case, file, line) is repeated. ``block_bytes`` is the size of the blocks in which
    the feed files are read, if it is to be another than that of the session.
    """
    report = IngestReport()
    files = _files(spark, source, prefix, report)
    report.skipped = [f.name for f in files if f.table is None]
    files = [f for f in files if f.table is not None]
    require_distinct_names(files)
    if not files:
        raise FeedError("no feed files to load")
    base = versions.latest(spark, bronze)
    headers = _headers(spark, files, report)
    run = uuid.uuid4().hex
    chosen = {t: {f: h for f, h in headers.items() if f.table == t} for t in TABLE_COLUMNS}
    chosen = {t: of_table for t, of_table in chosen.items() if of_table}
    # the tables do not need each other: so the tail of one's stages does not leave the cluster idle
    with _blocks_of(spark, block_bytes):
        staged = side_by_side(spark, lambda t: _stage_table(spark, t, chosen[t], f"{bronze}/_stage/{run}", block_bytes), chosen)
    staged = dict(zip(chosen, staged))
    loads = side_by_side(spark, lambda t: _load_table(spark, t, chosen[t], staged[t], bronze, run), chosen)
    fresh = [row for load in loads for row in load.files]
    repeated = [f"{r.table_name} of {r.file_name}: {r.repeated}" for r in fresh if r.repeated]
    if repeated:
        _log_failed(spark, bronze, files)
        raise FeedError(f"repeated keys (case, file, line) in {'; '.join(repeated)}")
    if headers:
        manifest = spark.createDataFrame([tuple(r)[:5] for r in fresh], versions.MANIFEST)
        if append:
            manifest = versions.merged(versions.manifest(spark, bronze, base), manifest)
        versions.publish(spark, bronze, base, run, manifest)
    for load in loads:
        _report(spark, load, bronze, append, report)
    remove_folder(spark, f"{bronze}/_stage/{run}")
    if report.failed:
        _log_failed(spark, bronze, [f for f in files if f.name in report.failed])
        raise FeedError("; ".join(f"{n}: {why}" for n, why in report.failed.items()))
    return report


def _log_failed(spark: SparkSession, bronze: str, files: Sequence[FeedFile]) -> None:
    rows = spark.createDataFrame([(f.file_name, f.table) for f in files], "file_name string, table_name string")
    _log(rows.withColumns({"rows_imported": F.lit(0).cast("bigint"), "rows_rejected": F.lit(0).cast("bigint")}),
         bronze, "import_summary")


def _headers(
    spark: SparkSession, files: list[FeedFile], report: IngestReport
) -> dict[FeedFile, tuple[str, ...]]:
    """Headers of the usable files; a bad file is noted and does not stop the others."""

    def header(file: FeedFile) -> tuple[str, ...] | None:
        try:
            found = header_of(spark, file)
            lacking = missing_columns(file, found)
            if not lacking:
                return found
            report.failed[file.name] = f"lacks {', '.join(lacking)}"
        except Exception as error:  # noqa: BLE001
            report.failed[file.name] = str(error)
        return None

    # each is a tiny job that reads one line
    with ThreadPoolExecutor(16) as pool:
        found = list(pool.map(inheritable_thread_target(spark)(header), files))
    return {f: h for f, h in zip(files, found) if h is not None}


def _files(spark, source, prefix: str, report: IngestReport) -> list[FeedFile]:
    if isinstance(source, str):
        return list_feed(spark, [source], prefix)
    if all(isinstance(f, FeedFile) for f in source):
        return list(source)
    named = [p for p in source if p.endswith(".csv")]
    existing, report.missing = split_missing(spark, named)
    return list_feed(spark, existing, prefix) if existing else []


@dataclass(frozen=True)
class TableLoad:
    """One table of a run, written but not yet published."""

    table: str
    names: list[str]
    staged: DataFrame
    files: list[Row]
    counts: dict[str, Row]
    bad: list[Row]


@contextmanager
def _blocks_of(spark: SparkSession, block_bytes: int | None) -> Iterator[None]:
    """Blocks of another size while feed files are read."""
    if block_bytes is None:
        yield
        return
    usual = spark.conf.get(BLOCK_SIZE)
    spark.conf.set(BLOCK_SIZE, str(block_bytes))
    try:
        yield
    finally:
        spark.conf.set(BLOCK_SIZE, usual)


def _reading_tasks(spark: SparkSession, block_bytes: int | None, size: int) -> int | None:
    """Number of tasks that read feed files of ``size`` bytes in blocks of a chosen size, each ``TASK_BYTES`` at most or
    one block."""
    if block_bytes is None:
        return None
    return max(spark.sparkContext.defaultParallelism, -(-size // max(block_bytes, TASK_BYTES)))


def _stage_table(
    spark: SparkSession, table: str, headers: dict[FeedFile, tuple[str, ...]], folder: str, block_bytes: int | None = None
) -> str:
    """Parse the files of one table to a columnar copy, once: everything after reads that."""
    stage = f"{folder}/{table}"
    tasks = _reading_tasks(spark, block_bytes, sum(f.size for f in headers))
    read_feed(spark, table, headers, tasks).write.options(**WRITTEN).parquet(stage)
    return stage


def _load_table(
    spark: SparkSession, table: str, headers: dict[FeedFile, tuple[str, ...]], stage: str, bronze: str, run: str
) -> TableLoad:
    staged = spark.read.parquet(stage)
    accepted = staged.filter(F.col(REJECTED).isNull()).drop(REJECTED)
    rows = number_lines(typed(accepted, table)).withColumn("run", F.lit(run))
    rows.write.mode("append").options(**WRITTEN).partitionBy("run", "FILE_NAME").parquet(f"{bronze}/{table}")
    names = sorted(f.file_name for f in headers)
    written = [] if accepted.isEmpty() else [(table, n, run) for n in names]  # no rows, no folder
    written = spark.createDataFrame(written, "table_name string, file_name string, run string")
    files = versions.file_keys(versions.rows_of(spark, bronze, table, written), table, run)
    counts = staged.groupBy("FILE_NAME").agg(
        F.count_if(F.col(REJECTED).isNull()).alias("rows_imported"),
        F.count_if(F.col(REJECTED).isNotNull()).alias("rows_rejected"),
    )
    # one row per file, or per file and column: small enough to report back
    return TableLoad(table, names, staged, files.collect(), {r.FILE_NAME: r for r in counts.collect()},
                     unparseable_counts(accepted, table).collect())


def _report(spark: SparkSession, load: TableLoad, bronze: str, append: bool, report: IngestReport) -> None:
    """Log what a published load brought, and note it in ``report``."""
    table = load.table
    bad = spark.createDataFrame([(r.FILE_NAME, r.column, r.bad) for r in load.bad], "FILE_NAME string, column string, bad bigint")
    _log(bad.withColumn("table_name", F.lit(table)), bronze, "unparseable")
    _log(
        load.staged.filter(F.col(REJECTED).isNotNull()).select(
            F.col("FILE_NAME").alias("file_name"), F.lit(table).alias("table_name"),
            F.col("ordinal").alias("record"), F.lit("FIELD COUNT").alias("error_type"),
            F.col(REJECTED).alias("csv_line"),
            F.concat(F.lit("record does not have the fields of the header; lines: "), F.col("lines")).alias("error_message"),
        ),
        bronze, "rejects",
    )
    for name in load.names:
        found = load.counts.get(name)
        report.imported[name] = found.rows_imported if found else 0
        report.rejected[name] = found.rows_rejected if found else 0
        if append and report.imported[name] == 0:
            report.kept_existing.append(name)
    for row in load.bad:
        report.unparseable[(row.FILE_NAME, row.column)] = row.bad
    summary = [(n, table, report.imported[n], report.rejected[n]) for n in load.names]
    _log(spark.createDataFrame(
        summary, "file_name string, table_name string, rows_imported bigint, rows_rejected bigint"), bronze, "import_summary")


def _log(df: DataFrame, bronze: str, name: str) -> None:
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(f"{bronze}/{name}")


def bronze_table(spark: SparkSession, bronze: str, table: str, version: int | None = None) -> DataFrame:
    """One table of the latest version, or of an earlier one by its number."""
    files = versions.manifest(spark, bronze, versions.version_of(spark, bronze, version))
    return versions.rows_of(spark, bronze, table, files)


def bronze_tables(spark: SparkSession, bronze: str, version: int | None = None) -> RawTables:
    """The bronze tables as inputs of the case model."""
    return RawTables(*[bronze_table(spark, bronze, t, version) for t in ("submissions", "vaccines", "terms")])
