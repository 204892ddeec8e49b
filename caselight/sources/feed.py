"""Reading the yearly CSV feed: windows-1252, quoted multi-line fields, drifting headers.

A *feed file* is a file, or a folder of part files, whose name ends in ``.csv``; its name says
which table it belongs to and whether it is domestic. Every file becomes rows of text columns
plus ``FILE_NAME``, an ``ordinal`` that grows in file order, and ``_rejected`` (the raw record)
where the record does not fit the header.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caselight import fixed_values as fv
from caselight.functions.text import decode_windows_1252

REJECTED = "_rejected"
# fixed values: name token -> table, tried in this order
TABLE_TOKENS = {"DATA": "submissions", "SYMPTOMS": "terms", "VAX": "vaccines"}
NON_DOMESTIC = "NONDOMESTIC"

TABLE_COLUMNS = {
    "submissions": fv.SUBMISSION_COLUMNS,
    "vaccines": fv.VACCINE_COLUMNS,
    "terms": fv.TERM_COLUMNS,
}

_CSV_OPTIONS = {
    "quote": '"',
    "escape": '"',
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": REJECTED,
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


#: Blocks whose sizes (a path and two numbers each) are broadcast; more are joined by shuffle.
BROADCAST_BLOCKS = 100_000


class FeedError(RuntimeError):
    """Input files that cannot be loaded as they are."""


def table_for(name: str, prefix: str = "") -> str | None:
    """Table a file belongs to by its name; ``prefix`` is what precedes the token in the
    names of a feed, and narrows the match. None means the file is skipped."""
    upper = name.upper()
    for token, table in TABLE_TOKENS.items():
        if prefix.upper() + token in upper:
            return table
    return None


def canonical_name(name: str) -> str:
    return name.upper()


@dataclass(frozen=True)
class FeedFile:
    path: str
    name: str
    size: int
    table: str | None

    @property
    def file_name(self) -> str:
        return canonical_name(self.name)


def _feed_file_of(path: str) -> tuple[str, str] | None:
    """(path, name) of the outermost path component named like a CSV."""
    parts = path.split("/")
    for i, part in enumerate(parts):
        if part.lower().endswith(".csv"):
            return "/".join(parts[: i + 1]), part.split("=")[-1]
    return None


def list_feed(spark: SparkSession, paths: Sequence[str], prefix: str = "") -> list[FeedFile]:
    """The feed files under some paths (only names and sizes are read), in name order."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv")
        .load(list(paths))
        .select("path", "length")
    )
    sizes: dict[tuple[str, str], int] = {}
    for path, length in found.toLocalIterator():
        key = _feed_file_of(path)
        if key:
            sizes[key] = sizes.get(key, 0) + length
    files = [FeedFile(p, n, size, table_for(n, prefix)) for (p, n), size in sizes.items()]
    return sorted(files, key=lambda f: (f.file_name, f.path))


def split_missing(spark: SparkSession, paths: Iterable[str]) -> tuple[list[str], list[str]]:
    """(existing, missing) of a list of named paths."""
    existing, missing = [], []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = hadoop(path)
        (existing if where.getFileSystem(conf).exists(where) else missing).append(path)
    return existing, missing


def latest_vintage(vintages: Sequence[Sequence[FeedFile]]) -> list[FeedFile]:
    """Files of several deliveries, oldest delivery first: a later copy of a file replaces an
    earlier one of the same canonical name."""
    chosen: dict[str, FeedFile] = {}
    for delivery in vintages:
        for file in delivery:
            chosen[file.file_name] = file
    return sorted(chosen.values(), key=lambda f: f.file_name)


def require_distinct_names(files: Iterable[FeedFile]) -> None:
    seen: dict[str, str] = {}
    for file in files:
        if file.file_name in seen:
            raise FeedError(f"{seen[file.file_name]} and {file.path} are the same file {file.file_name}")
        seen[file.file_name] = file.path


def header_of(spark: SparkSession, file: FeedFile) -> tuple[str, ...]:
    """Column names of a file; its first column is the case id whatever it is called."""
    names = spark.read.options(header="true", encoding="ISO-8859-1", **{"quote": '"', "escape": '"'}).csv(
        file.path
    ).columns
    return (fv.CASE_ID, *(n.strip() for n in names[1:]))


def missing_columns(file: FeedFile, header: Sequence[str]) -> list[str]:
    return [c for c in TABLE_COLUMNS[file.table] if c not in header]


def read_feed(
    spark: SparkSession, table: str, headers: dict[FeedFile, tuple[str, ...]], tasks: int | None = None
) -> DataFrame:
    """All files of one table as text rows, one read per header signature.

    Files of different headers are aligned by name. Files of any size are read in blocks that parse in parallel,
    several by one task if there are more of them than ``tasks``. Files in which every line is a record of its own
    are told apart first: their lines parse where they are read.
    """
    plain, blocks = _plain_files(spark, [f.path for f in headers], tasks)
    groups: dict[tuple[tuple[str, ...], bool], list[FeedFile]] = {}
    for file, header in headers.items():
        groups.setdefault((header, file.file_name in plain), []).append(file)
    wanted = [*TABLE_COLUMNS[table], fv.ORDER_COLUMN]
    frames = []
    for (header, by_line), files in groups.items():
        paths = [f.path for f in files]
        if by_line:
            rows = _read_lines(spark, paths, header, tasks, blocks <= BROADCAST_BLOCKS)
        else:
            rows = _read_records(spark, paths, header, tasks)
        kept = [c for c in header if c in wanted]
        frames.append(
            rows.select(
                *[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in kept],  # an empty field is NULL, quoted or not
                "FILE_NAME", "path", "ordinal", "place", "lines", REJECTED,
            )
        )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _file_name(path: Column) -> Column:
    """Canonical name of the feed file a (part) file belongs to."""
    return F.upper(F.regexp_extract(path, r"(?i)^.*?/(?:[^/=]+=)?([^/=]+\.csv)(?:/.*)?$", 1))


def _decoded_path(path: Column) -> Column:
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


# A quoted field's text up to its closing quote, fields with their commas, and a quoted field left open.
# All quantifiers are possessive: no backtracking, and no recursion on long lines.
_QUOTED = '[^"]*+(?:""[^"]*+)*+'
_FIELDS = f'(?:(?:"{_QUOTED}"[^,]*+|[^",][^,]*+|),)*+'
_LEFT_OPEN = f'"{_QUOTED}$'
OPENS_OUTSIDE = f"^{_FIELDS}{_LEFT_OPEN}"
OPEN_INSIDE = f'^{_QUOTED}(?:$|"[^,]*+,{_FIELDS}{_LEFT_OPEN})'


def _carried(frame: DataFrame, along: list[str], order: str) -> DataFrame:
    """``frame`` with ``start_0`` and ``start_1``: whether a quoted field is open where a row begins, if none
    (one) is where its partition begins.

    A row maps the state before it to the state after it (``after_0``, ``after_1``). Maps compose: the last row
    that ends the same way whatever came before decides, and each later row that swaps the two states flips it.
    """
    before = Window.partitionBy(*along).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    fixed, swaps = F.col("after_0") == F.col("after_1"), F.col("after_0") > F.col("after_1")
    frame = frame.withColumn("flips", F.coalesce(F.sum(swaps.cast("int")).over(before), F.lit(0)))
    last = F.last(F.when(fixed, F.struct("after_0", "flips")), ignorenulls=True).over(before)
    frame = frame.withColumn("last", last)
    decided = F.pmod(F.col("last.after_0") + F.col("flips") - F.col("last.flips"), F.lit(2))
    return frame.withColumns({
        f"start_{p}": F.coalesce(decided, F.pmod(F.col("flips") + p, F.lit(2))) for p in (0, 1)
    }).drop("last", "flips")


def _lines(spark: SparkSession, paths: list[str], tasks: int | None) -> DataFrame:
    """(file, block, row, line): the lines of some files, by their encoded paths; rows of a block follow each other.

    Lines are decoded whole, once: code for each of many columns grows beyond what the JVM compiles. They hold no CR.
    """
    line = decode_windows_1252(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    lines = spark.read.option("recursiveFileLookup", "true").text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        line.alias("line"),
    )
    return lines.coalesce(tasks) if tasks else lines


def _plain_files(spark: SparkSession, paths: list[str], tasks: int | None) -> tuple[set[str], int]:
    """Names of the files none of whose lines leaves a quoted field open, and the number of blocks of all files.

    No quoted field is open where a file begins, so in these files none ever is where a line begins.
    """
    opens = F.contains("line", F.lit('"')) & F.regexp_like("line", F.lit(OPENS_OUTSIDE))
    blocks = _lines(spark, paths, tasks).groupBy("file", "block").agg(F.max(opens).alias("opens"))
    found = blocks.groupBy(_file_name(_decoded_path(F.col("file"))).alias("name")).agg(
        F.max("opens").alias("opens"), F.count("*").alias("blocks")).collect()  # one row a file
    return {r.name for r in found if not r.opens}, sum(r.blocks for r in found)


def _read_lines(spark: SparkSession, paths: list[str], header: Sequence[str], tasks: int | None, few: bool) -> DataFrame:
    """What ``_read_records`` gives for files that ``_plain_files`` names: only the sizes of blocks (``few`` or not)
    are shuffled, to number the lines along a file."""
    lines = _lines(spark, paths, tasks)
    along_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    path = _decoded_path(F.col("file"))
    blocks = lines.groupBy("file", "block").agg(F.min("row").alias("first"), F.count("*").alias("n")).select(
        "file", "block", (F.coalesce(F.sum("n").over(along_file), F.lit(0)) + 1 - F.col("first")).alias("shift"),
        path.alias("path"), _file_name(path).alias("FILE_NAME"))
    records = lines.join(F.broadcast(blocks) if few else blocks, ["file", "block"]).select(
        "path", "FILE_NAME", (F.col("row") + F.col("shift")).alias("ordinal"), "line"
    ).filter((F.col("ordinal") > 1) & (F.col("line") != ""))  # the first line of a (part) file is its header
    ddl = ", ".join(f"`{c}` STRING" for c in [*header, REJECTED])
    parsed = records.select("path", "FILE_NAME", "ordinal", F.from_csv("line", ddl, _CSV_OPTIONS).alias("r"))
    return parsed.select("r.*", "path", "FILE_NAME", "ordinal", F.col("ordinal").alias("place"), F.lit(1).alias("lines"))


def _read_records(
    spark: SparkSession, paths: list[str], header: Sequence[str], tasks: int | None = None
) -> DataFrame:
    """Records of CSV files, parsed in parallel whatever the size of a file.

    CR, LF and CRLF all end a line. A line begins a record unless a quoted field is open there; a quote opens a
    field only where the field begins. How a line changes that is known for both cases before its file's earlier
    lines are; the cases are composed along each block (bounded, one window each), and the blocks' results, a few
    numbers each, along the file. Lines then group into records, which parse one by one.

    A stray opening quote takes lines up to the next quote, or all to the end of the file, into one record. So the
    lines of a record of several that does not fit the header, and of one that nothing closes, are read again one
    by one: those with the header's fields are kept, others rejected each.
    ``ordinal`` is the number of a record's first line, ``lines`` how many it has, ``place`` the number of the record
    if its lines were read as one.
    """
    lines = _lines(spark, paths, tasks).withColumn("path", _decoded_path(F.col("file"))).drop("file")
    quote = F.contains("line", F.lit('"'))  # a line without one leaves things as they are
    lines = _carried(lines.withColumns({
        "after_0": (quote & F.regexp_like("line", F.lit(OPENS_OUTSIDE))).cast("int"),
        "after_1": (~quote | F.regexp_like("line", F.lit(OPEN_INSIDE))).cast("int"),
    }), ["path", "block"], "row")
    in_block = Window.partitionBy("path", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumns({f"opened_{p}": F.sum(1 - F.col(f"start_{p}")).over(in_block) for p in (0, 1)})
    lines = lines.withColumn("number", F.count(F.lit(1)).over(in_block))
    ends = [F.max_by(F.when(F.col(f"start_{p}") == 0, F.col("after_0")).otherwise(F.col("after_1")), "row") for p in (0, 1)]
    blocks = lines.groupBy("path", "block").agg(
        ends[0].alias("after_0"), ends[1].alias("after_1"), F.max("opened_0").alias("starts_0"),
        F.max("opened_1").alias("starts_1"), F.max("number").alias("n"))
    blocks = _carried(blocks, ["path"], "block")
    starts = F.when(F.col("start_0") == 0, F.col("starts_0")).otherwise(F.col("starts_1"))
    left_open = F.when(F.col("start_0") == 0, F.col("after_0")).otherwise(F.col("after_1"))
    blocks = blocks.withColumns({"starts": starts, "left_open": left_open})
    along_file = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole_file = Window.partitionBy("path")
    blocks = blocks.select(
        "path", "block", F.col("start_0").alias("carry"),
        F.coalesce(F.sum("starts").over(along_file), F.lit(0)).alias("records_before"),
        F.coalesce(F.sum("n").over(along_file), F.lit(0)).alias("lines_before"),
        F.when(F.max_by("left_open", "block").over(whole_file) == 1, F.sum("starts").over(whole_file)).alias("endless"))
    opened_here = F.when(F.col("carry") == 0, F.col("opened_0")).otherwise(F.col("opened_1"))
    lines = lines.join(blocks, ["path", "block"]).withColumns({
        "record": F.col("records_before") + opened_here, "number": F.col("lines_before") + F.col("number")})
    # lines of an endless record stand alone
    alone = F.when(F.col("record") == F.col("endless"), F.col("number")).otherwise(F.lit(0))
    records = (
        lines.groupBy("path", "record", alone.alias("alone"))
        .agg(F.array_sort(F.collect_list(F.struct("number", "line"))).alias("all"))
        .select("path", F.col("all")[0]["number"].alias("ordinal"), F.size("all").alias("lines"),
                F.when(F.col("alone") == 0, F.col("record")).alias("place"),
                F.array_join(F.col("all.line"), "\n").alias("record"))
        # the first record of a (part) file is its header
        .filter((F.col("ordinal") > 1) & (F.col("record") != ""))
    )
    ddl = ", ".join(f"`{c}` STRING" for c in [*header, REJECTED])
    parsed = lambda text: F.from_csv(text, ddl, _CSV_OPTIONS)
    # only records of several lines are parsed to tell this; texts, not their many fields, go through the explode
    misfit = F.when(F.col("lines") > 1, parsed("record")[REJECTED].isNotNull()).otherwise(F.lit(False))
    records = records.withColumn("again", misfit)
    texts = F.when(F.col("again"), F.split("record", "\n")).otherwise(F.array("record"))
    parts = records.select("path", "ordinal", F.when(F.col("again"), F.lit(1)).otherwise(F.col("lines")).alias("lines"),
                           F.when(~F.col("again"), F.col("place")).alias("place"),
                           F.posexplode(texts).alias("skip", "text")).filter("text <> ''")
    return parts.withColumn("r", parsed("text")).select(
        "r.*", "path", _file_name(F.col("path")).alias("FILE_NAME"), (F.col("ordinal") + F.col("skip")).alias("ordinal"),
        "place", "lines")
