"""Reading and writing contact tables, requests, reports and pages."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, UnsupportedOperationException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions.text import WS_CHARACTERS, blank, or_null, strip
from leadloom.operators.consolidate import FIELDS, HEADER, coalesce_aliases

BOM = "\uFEFF"
DEFAULT_COLUMNS = ";".join(HEADER.values())
REPORT = "status string, profile string, writtenRows long, foundRows long, blockers array<string>, notes array<string>, csvPath string, error string, totalResults long, updatedAt timestamp"
REQUEST = "run_id string, objective string, leadType string, geography string, sources string, contactRule string, outputName string, columns string, extraInstructions string"


#: A character that is no text: lines come whole through the reader of separated values, which knows headers and splits.
_NOTHING = "\uFFFF"
#: Spark spells the beginning of a path with one slash or three.
_ONE_SLASH = re.compile("^([A-Za-z][A-Za-z0-9+.-]*):/+")
#: Files of one reading, and bytes of a file, that row numbers have room for, as powers of two.
FILE_BITS, BYTE_BITS = 20, 43


def split_cells(line: Column) -> Column:
    """Cells of a line.  A quote anywhere opens or closes; inside, two are one and ``;`` is text; an open end is fine.

    Parted at its quotes, a line is outside and inside by turns; an empty part
    outside, but for the ends, stands between two quotes of the inside.
    """

    def text(parts: Column) -> Column:
        last = F.size(parts) - 1
        outside = lambda p, i: F.when((p == "") & (i > 0) & (i < last), '"').otherwise(F.replace(p, F.lit(";"), F.lit("\n")))  # noqa: E731  a line holds no line feed
        return F.split(F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 0, outside(p, i)).otherwise(p)), ""), "\n", -1)

    return F.transform(F.array(F.split(line, '"', -1)), text)[0]  # parted once


def split_header(line: str) -> list[str]:
    """``split_cells`` of a header, trimmed."""
    parts = line.strip(WS_CHARACTERS).split('"')
    outside = ['"' if not p and 0 < i < len(parts) - 1 else p.replace(";", "\n") for i, p in enumerate(parts)]
    return [c.strip(WS_CHARACTERS) for c in "".join(p if i % 2 else outside[i] for i, p in enumerate(parts)).split("\n")]


def _listed(spark: SparkSession, path: str) -> list[str]:
    """The files of a path, by name; none if there is nothing."""
    try:
        return sorted(spark.read.format("binaryFile").load(path).inputFiles())
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def read_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``;`` files with a header, all text, trimmed, missing cells empty; ``_file`` and ``_row`` keep the order.

    A line is a row (no line breaks in cells), blank lines go, surplus cells are
    ignored, of columns with one name the last counts, missing paths are skipped.
    Paths may have different headers; the files of one path (a folder, a
    pattern) share that of its first.  ``_row`` follows the paths as given, then
    the files by name, then the lines, however Spark packs files into tasks: it
    puts together the place of the file, the start of the block that is read and
    the row within the task.  A task with several blocks reads no more bytes than
    one block has, so row and block start together still ascend within a file.
    """
    given = [paths] if isinstance(paths, str) else list(paths)
    listed = {p: _listed(spark, p) for p in dict.fromkeys(given)}
    files = list(dict.fromkeys(f for p in given for f in listed[p]))
    if len(files) > 1 << FILE_BITS:
        raise ValueError(f"more than {1 << FILE_BITS} files in one reading")
    reader = spark.read.options(sep=_NOTHING, quote="", escape="", lineSep="\n", header=True, enforceSchema=True, mode="PERMISSIVE")
    headers: dict[tuple[str, ...], list[str]] = {}
    for p, found in listed.items():
        if found and (columns := reader.csv(p).columns):
            headers.setdefault(tuple(split_header(columns[0].lstrip(BOM))), []).append(p)
    order = spark.createDataFrame([(i, _ONE_SLASH.sub(r"\1:/", f)) for i, f in enumerate(files)], "_place long, _path string")
    tables = []
    for header, of_it in headers.items():
        at = {name: i for i, name in enumerate(header)}  # of equal names the last
        line = strip(F.col("_line"))
        raw = reader.schema("_line string").csv(of_it).select(line.alias("_line"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
        placed = raw.where("_line <> ''").join(F.broadcast(order), F.regexp_replace("_file", _ONE_SLASH.pattern, "$1:/") == F.col("_path"))  # the list of files, which the driver holds anyway
        row = F.shiftleft("_place", BYTE_BITS) + F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
        cells = placed.select(split_cells(F.col("_line")).alias("_cells"), "_file", row.alias("_row"))
        tables.append(cells.select(*[strip(F.get("_cells", F.lit(i))).alias(name) for name, i in at.items()], "_file", "_row"))
    if not tables:
        return spark.createDataFrame([], "_file string, _row long")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def read_leads_csv(spark: SparkSession, paths: str | Sequence[str], profile_rank: int = 0) -> DataFrame:
    """The nine fields of contact files under any known header, with ``seq``."""
    rows = read_csv(spark, paths).withColumn("profile_rank", F.lit(profile_rank))
    return coalesce_aliases(rows).withColumn("seq", F.struct("profile_rank", F.col("_row").alias("row_no"))).select(*FIELDS, "seq", "_file")


def _cell(value: Column) -> Column:
    text = blank(value)
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[;\n\r"]'), quoted).otherwise(text)


def write_leads_csv(df: DataFrame, path: str, columns: str = DEFAULT_COLUMNS, order: Sequence[str] = ("seq",), single_file: bool = False, bom: bool = True) -> None:
    """Header and rows with CRLF, quotes only where needed; a column that ``df`` lacks is empty.

    Rows are in the order of the columns ``order`` (those that ``df`` has), by
    ranges, so files follow one another by name.  By default each of them has the
    header, and a byte-order mark before it (``bom``), and can be read alone.
    ``single_file`` joins them to one file with one header: by the file system
    where it can join files, else as a stream of bytes.  No task gets all rows.
    """
    fields = {v: k for k, v in HEADER.items()}
    present = {c.lower(): c for c in df.columns}
    wanted = [c.strip() for c in columns.split(";") if c.strip()]
    values = {c: F.col(f"`{present[n]}`") if (n := fields.get(c, c).lower()) in present or (n := c.lower()) in present else F.lit("") for c in wanted}
    by = [c for c in order if c.lower() in present]
    head = (BOM if bom else "") + ";".join(map(_quoted, wanted))
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df
    lines = rows.select(F.concat_ws(";", *[_cell(v) for v in values.values()]).alias("value"))

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            if batch.num_rows and not begun:
                begun = True
                yield pa.RecordBatch.from_arrays([pa.array([head])], schema=batch.schema)
            yield batch

    if not single_file:
        found = lines.mapInArrow(headed, "value string")
        if df.isEmpty():
            found = df.sparkSession.createDataFrame([(head,)], "value string").coalesce(1)
        found.write.mode("overwrite").option("lineSep", "\r\n").text(path)
        return
    lines.write.mode("overwrite").option("lineSep", "\r\n").text(path)
    _join_parts(df.sparkSession, path, head + "\r\n")


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"' if any(c in name for c in ';\n\r"') else name


def _join_parts(spark: SparkSession, folder: str, head: str) -> None:
    """The part files of a folder as one, ``part-00000.csv``, after ``head``."""
    java = spark._jvm.org.apache.hadoop
    at = java.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted((s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda p: p.getName())
    whole = java.fs.Path(at, "_joined")
    out = fs.create(whole, True)
    out.write(bytearray(head.encode()))
    try:
        out.close()
        if parts:
            array = spark.sparkContext._gateway.new_array(java.fs.Path, len(parts))
            for i, p in enumerate(parts):
                array[i] = p
            fs.concat(whole, array)
    except (Py4JJavaError, UnsupportedOperationException):  # this file system can't
        out = fs.create(whole, True)
        out.write(bytearray(head.encode()))
        for p in parts:
            data = fs.open(p)
            java.io.IOUtils.copyBytes(data, out, 1 << 20, False)
            data.close()
        out.close()
    for s in fs.listStatus(at):
        if s.getPath().getName().startswith("part-"):
            fs.delete(s.getPath(), False)
    fs.rename(whole, java.fs.Path(at, "part-00000.csv"))


def write_by_source(df: DataFrame, path: str) -> None:
    """One folder per run and profile."""
    df.write.mode("overwrite").partitionBy("run_id", "profile").parquet(path)


def read_by_source(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a layout by run and profile; both come from the path."""
    return spark.read.option("basePath", path).parquet(path)


def read_source_reports(spark: SparkSession, paths: str | Sequence[str], lines: bool = False) -> DataFrame:
    """Progress documents, one per file or (``lines``) one per line; unreadable ones count as empty."""
    return spark.read.schema(REPORT).option("multiLine", not lines).option("mode", "PERMISSIVE").json(paths)


def write_source_reports(df: DataFrame, path: str) -> None:
    """Documents one per line."""
    df.write.mode("overwrite").json(path)


def with_request_defaults(requests: DataFrame) -> DataFrame:
    # fixed values
    defaults = {"leadType": "leads", "geography": "Portugal", "outputName": "leads.csv", "columns": DEFAULT_COLUMNS}
    return requests.withColumns({c: F.coalesce(or_null(strip(F.col(c))), F.lit(d)) for c, d in defaults.items()})


def read_requests(spark: SparkSession, paths: str | Sequence[str], lines: bool = False) -> DataFrame:
    """Request documents, one per file or (``lines``) one per line, with the defaults."""
    return with_request_defaults(spark.read.schema(REQUEST).option("multiLine", not lines).json(paths))


def read_pages(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Fetched pages as url and html: a Parquet table, or a folder of HTML files named by their path."""
    if form == "parquet":
        return spark.read.parquet(path)
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def write_pages(pages: DataFrame, table: str, path: str, buckets: int = 64) -> None:
    """Fetched pages as a table at ``path``, in buckets by address, sorted in each.

    A join by address with a table read from it shuffles the other side only, so
    markup stays where it lies.  Choose as many buckets as leave each below a few
    hundred MB.
    """
    pages.write.mode("overwrite").option("path", path).bucketBy(buckets, "url").sortBy("url").saveAsTable(table)


def write_result(df: DataFrame, path: str, run_id: str, version: int) -> None:
    """An output of a run, committed by an entry in the manifest once all its files are there."""
    marked = df.sparkSession.createDataFrame([(run_id, version)], "run_id string, version int")
    df.drop("run_id", "version").write.mode("overwrite").parquet(_version(path, run_id, version))
    marked.coalesce(1).write.mode("append").partitionBy("run_id").parquet(f"{path}/_manifest")


def _version(path: str, run_id: str, version: int) -> str:
    return f"{path}/run={quote(run_id, safe='')}/version={version}"


def latest_result(spark: SparkSession, path: str, run_id: str) -> DataFrame | None:
    """The newest committed output of a run, with ``run_id`` and ``version``; None if there is none.

    Only the manifest of the run and the files of that version are read; what a
    broken job has left is never seen.
    """
    if not _listed(spark, f"{path}/_manifest"):
        return None
    entries = spark.read.schema("version int, run_id string").parquet(f"{path}/_manifest")
    newest = entries.where(F.col("run_id") == run_id).agg(F.max("version")).first()[0]
    if newest is None:
        return None
    return spark.read.parquet(_version(path, run_id, newest)).select(F.lit(run_id).alias("run_id"), F.lit(newest).alias("version"), "*")
