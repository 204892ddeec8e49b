"""Where model tables are written: bucketed by case, versioned, published last.

A version is a folder. Readers only ever see versions listed in the ``published`` log, which
is appended to after the checks passed, so a failed build leaves the served model alone.
Tables of a version live in the shared folder and survive the loss of executors.

A version made by a refresh holds only the buckets that changed; its other buckets are read from the folders of the
versions before (``Part``).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Collection
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight import fixed_values as fv
from caselight.session import WRITTEN
from caselight.sources.star_tables import scan_bytes

CASE_ID = fv.CASE_ID


@dataclass(frozen=True)
class Layout:
    """Bucketed by case, so joins and per-case distincts need no exchange; sorted within a
    bucket, so Parquet row-group statistics prune ranges of the sort column."""

    bucketed: bool = True
    sort_by: tuple[str, ...] = ()
    postings: str = ""  # columns, filed in a folder for each value of ``part``, so that one label reads one folder


LAYOUTS = {
    "reports": Layout(sort_by=("VAX_DATE",)),
    "reports_vax": Layout(sort_by=("VAX_TYPE",)),
    "vax_details": Layout(),
    "vocabulary": Layout(bucketed=False),
    "symptoms": Layout(bucketed=False),
    "reports_symptoms": Layout(sort_by=("SYMPTOM_ID",)),
    "symptom_bg": Layout(bucketed=False),
    "term_counts": Layout(bucketed=False),
    "term_cases": Layout(bucketed=False, postings=f"TERM string, {CASE_ID} string, part int"),
    "manu_cases": Layout(bucketed=False, postings=f"VAX_MANU string, {CASE_ID} string, part int"),
    "narrative_grams": Layout(bucketed=False, postings="GRAM string, BUCKET int, part int"),
    "raw_submissions": Layout(sort_by=(CASE_ID,)),
    "raw_vaccines": Layout(sort_by=(CASE_ID,)),
    "raw_terms": Layout(sort_by=(CASE_ID,)),
}


SELECTION = Layout()


@dataclass(frozen=True)
class Part:
    """What one version's folder gives to a table: all its buckets but those that a later part replaces."""

    version: str
    without: frozenset[int] = frozenset()


def bucket_of(case_id: Column, buckets: int) -> Column:
    """The bucket in which Spark files a case."""
    return F.pmod(F.hash(case_id), F.lit(buckets))


def file_bucket() -> Column:
    """The bucket of the file that a row of a bucketed table lies in; as a predicate it skips whole files."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"_(\d+)(?:\.c\d+)?\.", 1).cast("int")


class ModelStore:
    def __init__(self, spark: SparkSession, folder: str, version: str, buckets: int | None = None,
                 parts: dict[str, tuple[Part, ...]] | None = None, bronze: int | None = None):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.version = version
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        #: Tables that earlier versions hold a part of; the others lie in this version's folder alone.
        self.parts = parts or {}
        #: Number of the bronze version that the model was built from.
        self.bronze = bronze

    def path(self, table: str) -> str:
        return f"{self.folder}/version={self.version}/{table}"

    def _catalog_name(self, table: str) -> str:
        # the catalog entry only carries the bucketing of the files under path()
        token = hashlib.sha256(f"{self.folder} {self.version}".encode()).hexdigest()[:16]
        return f"caselight_{token}_{table}"

    def save(self, table: str, df: DataFrame, in_place: bool = False) -> DataFrame:
        """Write ``df`` to this version's folder and read it back; ``in_place`` says that its rows come by case bucket."""
        layout = LAYOUTS.get(table, SELECTION)
        if layout.postings:
            # skewed parts are split by the rebalancing; sorted rows keep a label in few row groups
            label, held = df.columns[:2]
            df.hint("rebalance", "part").sortWithinPartitions("part", label, held).write.mode("overwrite").options(
                **WRITTEN).partitionBy("part").parquet(self.path(table))
            return self._piece(table, Part(self.version))
        if not layout.bucketed:
            df.write.mode("overwrite").options(**WRITTEN).parquet(self.path(table))
            return self._piece(table, Part(self.version))
        writer = (
            (df if in_place else df.repartition(self.buckets, CASE_ID))
            .write.mode("overwrite")
            .format("parquet")
            .options(path=self.path(table), **WRITTEN)
            .bucketBy(self.buckets, CASE_ID)
        )
        if layout.sort_by:
            writer = writer.sortBy(*layout.sort_by)
        writer.saveAsTable(self._catalog_name(table))
        return self._piece(table, Part(self.version))

    def load(self, table: str, buckets: Collection[int] | None = None) -> DataFrame:
        """The written table, with its bucketing; of bucketed tables, only some ``buckets`` if they are named."""
        parts = self.parts.get(table, (Part(self.version),))
        return reduce(DataFrame.unionByName, [self._piece(table, part, buckets) for part in parts])

    def _piece(self, table: str, part: Part, buckets: Collection[int] | None = None) -> DataFrame:
        where = self if part.version == self.version else ModelStore(self.spark, self.folder, part.version, self.buckets)
        layout = LAYOUTS.get(table, SELECTION)
        if layout.postings:
            # a schema is needed where no label has a case: there is no file to tell it
            df = self.spark.read.schema(layout.postings).parquet(where.path(table))
        elif not layout.bucketed:
            df = self.spark.read.parquet(where.path(table))
        else:
            if not self.spark.catalog.tableExists(where._catalog_name(table)):
                where._attach(table)
            df = self.spark.table(where._catalog_name(table))
            if buckets is not None:
                df = df.filter(file_bucket().isin(sorted(set(buckets) - part.without)))
        if part.without and buckets is None:
            # by row, not by file: a predicate on the file's name would hide the bucketing of a union of parts
            bucket = F.col("BUCKET") if "BUCKET" in df.columns else bucket_of(F.col(CASE_ID), self.buckets)
            df = df.filter(~bucket.isin(sorted(part.without)))
        return df

    def bytes_of(self, table: str, buckets: Collection[int] | None = None) -> int:
        """Size of a table's files, or of those of some buckets."""
        total = 0
        for part in self.parts.get(table, (Part(self.version),)):
            folder = f"{self.folder}/version={part.version}/{table}"
            for name, size in files_of(self.spark, folder):
                found = re.search(r"_(\d+)(?:\.c\d+)?\.", name)
                bucket = int(found[1]) if found and LAYOUTS[table].bucketed else None
                if bucket not in part.without and (buckets is None or bucket is None or bucket in buckets):
                    total += size
        return total

    def _attach(self, table: str) -> None:
        """Tell this session's catalog about bucketed files another session wrote."""
        layout = LAYOUTS[table]
        schema = self.spark.read.parquet(self.path(table)).schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        ordered = f"SORTED BY ({', '.join(layout.sort_by)}) " if layout.sort_by else ""
        self.spark.sql(
            f"CREATE TABLE {self._catalog_name(table)} ({columns}) USING parquet "
            f"CLUSTERED BY ({CASE_ID}) {ordered}INTO {self.buckets} BUCKETS LOCATION '{self.path(table)}'"
        )

    def publish(self) -> None:
        self.spark.range(1).select(
            F.lit(self.version).alias("version"), F.lit(self.buckets).alias("buckets"),
            F.current_timestamp().alias("published_at"), F.lit(self.bronze).cast("bigint").alias("bronze"),
            F.lit(json.dumps({t: [[p.version, sorted(p.without)] for p in ps] for t, ps in self.parts.items()})).alias("parts"),
        ).write.mode("append").parquet(f"{self.folder}/published")

    @classmethod
    def published(cls, spark: SparkSession, folder: str) -> "ModelStore | None":
        """The latest published version of ``folder``, if any."""
        try:
            log = spark.read.schema(
                "version string, buckets int, published_at timestamp, bronze bigint, parts string"
            ).parquet(f"{folder.rstrip('/')}/published")
        except AnalysisException:
            return None
        latest = log.orderBy(F.desc("published_at")).first()
        parts = {t: tuple(Part(v, frozenset(without)) for v, without in ps)
                 for t, ps in json.loads(latest.parts or "{}").items()}
        return cls(spark, folder, latest.version, latest.buckets, parts, latest.bronze)


def files_of(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(name, bytes) of all data files below a folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    listed = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True)
    found = []
    while listed.hasNext():
        status = listed.next()
        name = status.getPath().getName()
        if not name.startswith(("_", ".")):
            found.append((name, status.getLen()))
    return found


#: Buckets that Spark takes at most unless ``spark.sql.sources.bucketing.maxBuckets`` says otherwise.
SPARK_MAX_BUCKETS = 100_000


def bucket_count(spark: SparkSession, *inputs: DataFrame, bytes_per_bucket: int = 32 << 20) -> int:
    """Buckets for a model over ``inputs``: enough for their size (of the files, as the scan
    reports it), no fewer than the cores, no more than Spark takes."""
    total = sum(scan_bytes(df) for df in inputs)
    least = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", str(SPARK_MAX_BUCKETS)))
    return min(max(-(-total // bytes_per_bucket), least), most)
