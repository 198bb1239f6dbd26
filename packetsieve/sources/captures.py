"""Reads packet captures: one CSV file per capture, chosen by the date in its name.

Tasks read the first line of each file; the driver sees each distinct header once.
However many there are, one scan reads all files by place, and a small table says
which column each place of a header is.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import null_spellings_to_null
from ..functions.names import capture_date, capture_file_name
from ..schema import text_schema
from ..session import scratch_path

FILE_NAME = "file_name"
#: A file's path as scans give it in ``_metadata.file_path``.
URI = "uri"
HEADER_READERS = 32
HEADER_CHUNK = 1 << 13


def list_captures(spark: SparkSession, pattern: str) -> DataFrame:
    """``(path, file_name, uri)`` of the files under a path pattern; contents are not read."""
    # An aggregated or filtered listing of this source never loads ``content``.
    files = spark.read.format("binaryFile").load(pattern)
    uri = F.col("_metadata.file_path")
    return files.select("path", capture_file_name(uri).alias(FILE_NAME), uri.alias(URI))


def _within(date: Column, start, end) -> Column:
    """Inclusive range, either end open when None."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (date >= F.lit(start).cast("date"))
    if end is not None:
        keep = keep & (date <= F.lit(end).cast("date"))
    return keep


def prune_strict(files: DataFrame, start=None, end=None) -> DataFrame:
    """Captures dated in the range; a name without a date fails the job.

    Without any date the names are not looked at.
    """
    if start is None and end is None:
        return files
    date = capture_date(F.col(FILE_NAME), keep_ending=True)
    checked = F.coalesce(
        date,
        F.raise_error(F.concat(F.lit("no date in capture name "), F.col(FILE_NAME))).cast("date"),
    )
    return files.where(_within(checked, start, end))


def prune_lenient(files: DataFrame, start, end) -> DataFrame:
    """Captures dated in the range; a name without a date is left out."""
    date = capture_date(F.col(FILE_NAME))
    return files.where(date.isNotNull() & _within(date, start, end))


# Headers


Header = tuple[str, ...]


def _names(line: str | None) -> Header | None:
    """Column names of a header line, None for an empty file."""
    return tuple(next(csv.reader([line.lstrip("\ufeff")]))) if line else None


def _open(uri: str):
    store, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return store.open_input_stream(path)


def _is_known_store(uri: str) -> bool:
    """Whether tasks can open files of this store without Spark."""
    try:
        fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    except (pa.ArrowException, OSError):
        return False
    return True


def _first_line(uri: str) -> str | None:
    """First line of a file; no more than its first chunks are read."""
    line = b""
    with _open(uri) as stream:
        while chunk := stream.read(HEADER_CHUNK):
            ends = [i for i in (chunk.find(b"\n"), chunk.find(b"\r")) if i >= 0]
            line += chunk[: min(ends)] if ends else chunk
            if ends:
                break
    return line.decode("utf-8", "replace") or None


def _header_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        headers, errors = [], []
        for uri in batch.column(1).to_pylist():
            header = error = None
            try:
                header = _names(_first_line(uri))
            except OSError as failure:
                error = str(failure)
            headers.append(header and list(header))
            errors.append(error)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(headers, pa.list_(pa.string())), pa.array(errors, pa.string())],
            ["path", URI, "header", "error"],
        )


def header_table(files: DataFrame) -> DataFrame:
    """``path``, ``uri``, ``header`` (null: empty or unreadable) and ``error`` of each file, read in tasks, once."""
    spark = files.sparkSession
    path = scratch_path(spark, "headers")
    schema = f"path string, {URI} string, header array<string>, error string"
    files.select("path", URI).mapInArrow(_header_rows, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _line_on_driver(spark: SparkSession, path: str) -> str | None:
    """First line of a file, through the file system Spark reads it with."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)
    try:
        return jvm.java.io.BufferedReader(
            jvm.java.io.InputStreamReader(stream, "UTF-8")
        ).readLine()
    finally:
        stream.close()


def _headers_on_driver(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The same table for a store that only Spark can open."""
    listed = [(r["path"], r[URI]) for r in files.select("path", URI).collect()]

    def read(file: tuple[str, str]):
        try:
            return *file, _names(_line_on_driver(spark, file[0])), None
        except Py4JJavaError as error:
            io = spark.sparkContext._jvm.java.lang.Class.forName("java.io.IOException")
            if not io.isInstance(error.java_exception):
                raise
            return *file, None, str(error.java_exception)

    with ThreadPoolExecutor(HEADER_READERS) as pool:
        rows = [(p, u, h and list(h), e) for p, u, h, e in pool.map(read, listed)]
    return spark.createDataFrame(rows, f"path string, {URI} string, header array<string>, error string")


@dataclass(frozen=True)
class Layout:
    """Files to scan and the distinct headers they have, the one with the first path first."""

    paths: list[str]
    headers: list[Header]
    files: list[int]
    table: DataFrame | None


def layout_of(spark: SparkSession, files: DataFrame, skip_bad: bool, same_header: bool) -> Layout:
    """Headers of the listed files. One line per file is read, and no row.

    With ``same_header`` the first file speaks for all of them.
    """
    first = files.select("path", URI).orderBy("path").first()
    if first is None:
        return Layout([], [], [], None)
    if same_header:
        header = _names(_line_on_driver(spark, first["path"]))
        paths = sorted(r["path"] for r in files.select("path").collect()) if header else []
        return Layout(paths, [header] if header else [], [len(paths)], None)
    table = header_table(files) if _is_known_store(first[URI]) else _headers_on_driver(spark, files)
    if not skip_bad:
        bad = table.where("error IS NOT NULL").orderBy("path").first()
        if bad is not None:
            raise OSError(f"{bad['path']}: {bad['error']}")
    good = table.where("header IS NOT NULL")
    grouped = good.groupBy("header").agg(F.min("path").alias("first"), F.count("*").alias("files"))
    found = sorted(grouped.collect(), key=lambda r: r["first"])
    paths = sorted(r["path"] for r in good.select("path").collect())
    return Layout(paths, [tuple(r["header"]) for r in found], [r["files"] for r in found], good)


# Scans


RAW_RECORD = "_raw_record"


def _is_broken(first: str, widest: int, width: Column) -> Column:
    """Records with more fields than their header, or cut off by a line break in quotes.

    Spark keeps the text of records whose fields are not as many as the ``widest``
    header's; one with fewer than its own header's is right and has nulls at its end.
    """
    raw = F.col(RAW_RECORD)
    fields = ", ".join(f"c{i} string" for i in range(widest + 1))
    # No text equals this null value, so a field is null only where it is missing.
    parsed = F.from_csv(raw, fields, {"escape": '"', "nullValue": "\x01"})
    beyond = F.get(F.array(*[parsed[f"c{i}"] for i in range(widest + 1)]), width)
    quotes = F.length(raw) - F.length(F.replace(raw, F.lit('"'), F.lit("")))
    broken = F.coalesce(beyond.isNotNull() | (quotes % 2 == 1), F.lit(False))
    # Spark refuses to read nothing but the raw text, so a column is named as well.
    looked_at = raw.isNotNull() | F.col(f"`{first}`").eqNullSafe(F.lit("\x01"))
    return F.when(looked_at, broken).otherwise(width < widest)


def _reader(spark: SparkSession, columns, multi_line: bool):
    return (
        spark.read.schema(text_schema([*columns, RAW_RECORD]))
        .option("header", True)
        .option("escape", '"')
        .option("columnNameOfCorruptRecord", RAW_RECORD)
        # A pruned parse does not count the fields of a record.
        .option("columnPruning", False)
        .option("multiLine", multi_line)
    )


def _scan(spark: SparkSession, paths: list[str], header: Header, multi_line: bool) -> DataFrame:
    """Raw rows of files with one header, with ``file_name`` and the mark ``_broken``."""
    rows = _reader(spark, header, multi_line).option("enforceSchema", False).csv(paths)
    return rows.select(
        *[null_spellings_to_null(F.col(f"`{c}`")).alias(c) for c in header],
        capture_file_name(F.col("_metadata.file_path")).alias(FILE_NAME),
        _is_broken(header[0], len(header), F.lit(len(header))).alias("_broken"),
    )


def _scan_by_place(spark: SparkSession, layout: Layout, multi_line: bool) -> DataFrame:
    """The same for files with several headers, in one scan.

    Fields are read by place. Files with the most common header are not looked up;
    the others are joined by their path with their places. That table is written, so
    that Spark's own size check, which decides whether it is broadcast, knows its size.
    """
    names = list(dict.fromkeys(name for header in layout.headers for name in header))
    widest = max(len(h) for h in layout.headers)
    common = max(range(len(layout.headers)), key=lambda i: (layout.files[i], -i))
    places = [(list(h), [h.index(n) if n in h else None for n in names], len(h)) for h in layout.headers]
    headers = spark.createDataFrame(
        places[:common] + places[common + 1 :], "header array<string>, _places array<int>, _width int"
    )
    path = scratch_path(spark, "places")
    layout.table.join(F.broadcast(headers), "header").select(URI, "_places", "_width").write.parquet(path)
    others = spark.read.schema(f"{URI} string, _places array<int>, _width int").parquet(path)
    fields = [f"_field{i}" for i in range(widest)]
    uri = F.col("_metadata.file_path")
    rows = _reader(spark, fields, multi_line).csv(layout.paths).select(
        F.array(*fields).alias("_fields"), fields[0], RAW_RECORD, capture_file_name(uri).alias(FILE_NAME), uri.alias(URI)
    )
    usual = F.array(*[F.lit(place).cast("int") for place in places[common][1]])
    rows = rows.join(others, URI, "left").withColumns(
        {"_places": F.coalesce("_places", usual), "_width": F.coalesce("_width", F.lit(places[common][2]))}
    )
    values = [F.get("_fields", F.get("_places", F.lit(i))) for i in range(len(names))]
    return rows.select(
        *[null_spellings_to_null(v).alias(n) for n, v in zip(names, values)],
        FILE_NAME,
        _is_broken(fields[0], widest, F.col("_width")).alias("_broken"),
    )


def _checked(rows: DataFrame) -> DataFrame:
    """The rows; a broken record fails the job with the name of its file."""
    message = F.concat(F.lit("a record does not fit the header in "), F.col(FILE_NAME))
    fits = F.when(F.col("_broken"), F.raise_error(message).cast("boolean")).otherwise(True)
    return rows.where(fits).drop("_broken")


def _without_broken_files(rows: DataFrame) -> DataFrame:
    """Rows of the files that have no broken record; the others are left out whole."""
    broken = rows.where("_broken").select(FILE_NAME).distinct()
    kept = rows.drop("_broken")
    return kept.join(broken, FILE_NAME, "left_anti").select(*[F.col(f"`{c}`") for c in kept.columns])


def union_by_name(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts; a column that a part lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_captures(
    spark: SparkSession,
    files: DataFrame,
    on_empty: str = "raise",
    skip_bad: bool = False,
    same_header: bool = False,
    multi_line: bool = False,
) -> DataFrame | None:
    """Rows of the listed captures as text, plus ``file_name``.

    A column keeps its name whatever its place in a file; a column that a file
    lacks is null in its rows. Tasks read the header of each file. For very many files,
    ``same_header`` trusts that they all have the first one's header, which the scan
    itself then checks: another header fails the job. A record that is longer than
    the header, or that a line break in quotes cuts off, fails the job; with
    ``skip_bad`` its whole file is left out, as are files that cannot be opened.
    ``multi_line`` allows line breaks in quotes, at the price of one task per file.
    Without any file the result is an error, or None for ``on_empty="skip"``. The
    driver holds the paths of the files that are kept, as every Spark read does.
    """
    layout = layout_of(spark, files, skip_bad, same_header)
    if not layout.headers:
        if on_empty == "skip":
            return None
        raise FileNotFoundError("no captures in that range")
    if len(layout.headers) == 1:
        rows = _scan(spark, layout.paths, layout.headers[0], multi_line)
    else:
        rows = _scan_by_place(spark, layout, multi_line)
    return _without_broken_files(rows) if skip_bad else _checked(rows)


def training_captures(
    spark: SparkSession,
    pattern: str,
    start=None,
    end=None,
    same_header: bool = False,
    multi_line: bool = False,
) -> DataFrame | None:
    """Captures for training: strict names, None when there are none or they hold no row."""
    files = prune_strict(list_captures(spark, pattern), start, end)
    rows = read_captures(
        spark, files, "skip", same_header=same_header, multi_line=multi_line
    )
    return None if rows is None or rows.isEmpty() else rows


def captures_in_range(
    spark: SparkSession,
    pattern: str,
    start,
    end,
    same_header: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """Captures for scoring: lenient names and files, an error when there are none."""
    files = prune_lenient(list_captures(spark, pattern), start, end)
    return read_captures(
        spark, files, "raise", skip_bad=True, same_header=same_header, multi_line=multi_line
    )
