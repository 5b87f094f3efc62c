"""Reading one dataset: what format it has, clean column names, a dense row id.

Parquet, JSON and delimited files are read by Spark's readers, wherever they lie
and whatever their size; ragged rows are mended there too. Text keeps its exact
form (no type is guessed). Only workbooks are parsed in Python.
"""

from __future__ import annotations

import csv
import io
import os
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.functions.sqltext import quote
from tallyward.operators.checks import ROW
from tallyward.sources import xlsx
from tallyward.sources.records import in_order, records

EXTENSIONS = {"csv": "csv", "tsv": "tsv", "tab": "tsv", "json": "json", "xlsx": "xlsx", "parquet": "parquet", "pq": "parquet"}
WARN_BYTES, REFUSE_BYTES = 100 << 20, 500 << 20
#: A workbook is read on the driver; the limit holds for it whatever the policy for other formats.
WORKBOOK_BYTES = 500 << 20


class InputError(ValueError):
    """A dataset that cannot be read, said in plain words."""


def sniff(name: str, head: bytes) -> str:
    """csv, tsv, json, xlsx or parquet, by first bytes, else extension, else content."""
    if head[:4] == b"PAR1":
        return "parquet"
    if head[:4] == b"PK\x03\x04":
        return "xlsx"
    extension = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if extension in EXTENSIONS:
        return EXTENSIONS[extension]
    text = head.decode("utf-8", "replace").removeprefix("﻿").lstrip()
    if text[:1] in ("[", "{"):
        return "json"
    line = text.split("\n", 1)[0]
    return "tsv" if "\t" in line and line.count("\t") >= line.count(",") else "csv"


def size_verdict(size: int, warn: int = WARN_BYTES, refuse: int | None = None) -> str:
    """ok, warn or refuse. Nothing is refused for its size unless a limit is set."""
    return "refuse" if refuse is not None and size > refuse else "warn" if size >= warn else "ok"


def clean_names(names: Sequence[str | None]) -> list[str]:
    """Column names that are filled, unreserved and unique whatever the case."""
    out: list[str] = []
    taken: set[str] = set()
    for i, name in enumerate(names, 1):
        base = re.sub(r"\A_{2,}", "", (name or "").strip()) or f"column_{i}"
        found, k = base, 2
        while found.lower() in taken:
            found, k = f"{base}_{k}", k + 1
        taken.add(found.lower())
        out.append(found)
    return out


@dataclass
class Dataset:
    name: str
    path: str
    format: str
    data: DataFrame
    columns: list[str]
    sheet: str | None = None
    size_verdict: str = "ok"
    warnings: list[str] = field(default_factory=list)

    def count(self) -> int:
        return self.data.count()


def with_row_ids(df: DataFrame) -> DataFrame:
    """Dense row ids from 0 in the order of the input.

    Sizes of partitions are counted once, and a row's id is its place in its partition
    plus the sizes of those before; no row moves.
    """
    marked = df.withColumn("__nr", F.monotonically_increasing_id())
    part, place = F.shiftrightunsigned("__nr", 33), F.col("__nr").bitwiseAND((1 << 33) - 1)
    sizes = {r["p"]: r["n"] for r in marked.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = {}, 0
    for p in sorted(sizes):
        starts[p] = total
        total += sizes[p]
    if len(starts) <= 1:
        offset = F.lit(0).cast("long")
    elif len(starts) > 256:  # one row for each partition
        table = df.sparkSession.createDataFrame(list(starts.items()), "__part long, __start long")
        joined = marked.join(F.broadcast(table), part == F.col("__part"))
        return joined.withColumn(ROW, (place + F.col("__start")).cast("long")).drop("__nr", "__part", "__start")
    else:
        offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in starts.items() for x in pair]), part)
    return marked.withColumn(ROW, (place + offset).cast("long")).drop("__nr")


def _file(spark: SparkSession, path: str) -> tuple[object, object]:
    """File system and path of a file; of a folder's first file that holds data."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(at).isDirectory():
        inside = sorted((s for s in fs.listStatus(at) if s.isFile() and s.getPath().getName()[0] not in "._"), key=lambda s: s.getPath().getName())
        if inside:
            at = inside[0].getPath()
    return fs, at


def _head(spark: SparkSession, path: str, n: int = 4096) -> bytes:
    """The first bytes of a file, wherever it lies; no more of it is read."""
    fs, at = _file(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def _header(spark: SparkSession, path: str, delimiter: str) -> tuple[list[str], bool]:
    """Cells of the first record that is not blank, however long, and whether blank cells stand before it."""
    jvm = spark._jvm
    fs, at = _file(spark, path)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(at), "UTF-8"))
    csv.field_size_limit(1 << 30)
    lines: list[str] = []
    begun = before = False
    try:
        while (line := reader.readLine()) is not None:
            lines.append(line if begun else line.removeprefix("\ufeff"))
            begun = True
            if sum(x.count('"') for x in lines) % 2:
                continue
            cells = next(csv.reader(io.StringIO("\n".join(lines), newline=""), delimiter=delimiter), [])
            if any(c.strip() for c in cells):
                return cells, before
            before = before or bool(lines[0])
            lines.clear()
    finally:
        reader.close()
    return [], before


def _size(spark: SparkSession, path: str) -> int:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).getContentSummary(p).getLength()


def text_frame(spark: SparkSession, names: Sequence[str], rows: list[list[str | None]]) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def _in_one_piece(spark: SparkSession, path: str) -> bool:
    """Whether a file cannot be cut into lines: a folder, whose files have headers of their own, or one whose lines end with a carriage return alone."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return True
    return bool(re.search(rb"\r(?!\n|$)", re.sub(rb'"[^"]*+"?', b"", _head(spark, path, 1 << 16))))


def read_delimited(spark: SparkSession, path: str, delimiter: str) -> tuple[DataFrame, list[str]]:
    """All columns as text, and what was mended.

    Rows with other than the header's number of cells are padded or cut, and counted, on the executors,
    whatever the size and place of the file; a file is read by many tasks, line breaks in quotes or not.
    Rows without text are passed over; empty cells are null.
    """
    header, blank_before = _header(spark, path, delimiter)
    if not header:
        raise InputError("The file has no header row.")
    names = clean_names(header)
    raw = "__raw"
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, raw)])
    options = {"sep": delimiter, "quote": '"', "escape": '"', "multiLine": "true", "nullValue": "", "emptyValue": "", "maxColumns": str(max(20480, 4 * len(names))), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": raw}
    whole, placed = _in_one_piece(spark, path), False
    read_as = names
    if whole:
        df = spark.read.schema(schema).options(header="true", enforceSchema="true", **options).csv(path)
    else:
        found, placed = records(spark, path, delimiter)
        text = F.regexp_replace("text", "\r$", "")
        # a generator, so that no filter is put below, where each column that it asks for would be parsed anew
        read_as = [f"__c{i}" for i in range(len(names))]
        cells = F.inline(F.array(F.from_csv(text, ", ".join(f"{n} STRING" for n in (*read_as, raw)), options)))
        df = found.where("trim(text) <> ''").select(cells, *(["place"] if placed else []))
    kept = ["place"] if placed else []
    # what lies beyond the header's cells counts as text too; asked of cells as read, as the planner would derive 2^columns facts otherwise
    said = F.concat_ws("", *[F.col(quote(c)) for c in read_as], F.translate(raw, delimiter + '"', ""))
    df = df.where(said.rlike(r"(?U)\S"))
    df = df.select(*[F.nullif(F.col(quote(c)), F.lit("")).alias(n) for c, n in zip(read_as, names)], raw, *kept)
    cells = F.length(F.regexp_replace(F.regexp_replace(raw, '"[^"]*+"', ""), f"[^{delimiter}]++", "")) + 1
    short, long = (F.count_if(F.col(raw).isNotNull() & c) for c in (cells < len(names), cells > len(names)))
    mended = df.agg(short.alias("short"), long.alias("long")).first()
    df = in_order(df.drop(raw), ROW) if placed else with_row_ids(df.drop(raw))
    if blank_before or not whole:  # the header, or a row of blank cells that the reader took for it, is a row yet
        df = df.where(F.col(ROW) > 0).withColumn(ROW, F.col(ROW) - 1)
    warnings = []
    if n := mended["short"]:
        warnings.append(f"{n:,} rows had fewer cells than the header; the missing cells are empty.")
    if n := mended["long"]:
        warnings.append(f"{n:,} rows had more cells than the header; the extra cells were dropped.")
    return df, warnings


def read_json(spark: SparkSession, path: str, head: bytes) -> DataFrame:
    text = head[:4096].decode("utf-8", "replace").removeprefix("﻿").lstrip()
    if not text.startswith("[") or text[1:].lstrip()[:1] not in ("{", "]"):
        raise InputError("A JSON dataset must be an array of objects.")
    return with_row_ids(_renamed(spark.read.option("multiLine", True).json(path)))


def _renamed(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet in its own types; row ids need a count of each partition, not a pass over the columns."""
    return with_row_ids(_renamed(spark.read.parquet(path)))


def load_dataset(spark: SparkSession, path: str, sheet: str | None = None, format: str | None = None, refuse_bytes: int | None = None, name: str | None = None) -> Dataset:
    """Any dataset that Spark or this machine can reach; web addresses are refused."""
    if re.match(r"(?i)https?://", path):
        raise InputError("A dataset must be a path, not a web address. Download it first.")
    name = name or re.split(r"[/\\]", path.rstrip("/"))[-1]
    try:
        size = _size(spark, path)
    except Exception as e:
        raise InputError(f"'{path}' cannot be read.") from e
    verdict = size_verdict(size, refuse=refuse_bytes)
    if verdict == "refuse":
        raise InputError(f"'{name}' has {size:,} bytes; the limit is {refuse_bytes:,}.")
    extension = EXTENSIONS.get(name.rsplit(".", 1)[-1].lower())
    if size == 0:
        raise InputError(f"'{name}' is empty.")
    try:
        head = _head(spark, path)
    except Exception as e:
        raise InputError(f"'{path}' cannot be read.") from e
    kind = format or (extension if extension == "parquet" and not head else sniff(name, head))
    warnings: list[str] = []
    chosen = None
    try:
        if kind == "parquet":
            df = read_parquet(spark, path)
        elif kind == "json":
            df = read_json(spark, path, head)
        elif kind in ("csv", "tsv"):
            df, warnings = read_delimited(spark, path, "," if kind == "csv" else "\t")
        elif kind == "xlsx":
            if size > WORKBOOK_BYTES:
                raise InputError(f"A workbook of more than {WORKBOOK_BYTES:,} bytes cannot be read; save it as Parquet or CSV.")
            with open(path.removeprefix("file://"), "rb") as f:
                book = xlsx.Workbook(f.read())
            chosen = xlsx.choose_sheet(book.sheets, sheet)
            rows = [r for r in book.rows(chosen) if any(c not in (None, "") for c in r)]
            if not rows:
                raise InputError(f"The sheet '{chosen}' is empty.")
            width = len(rows[0])
            df = with_row_ids(text_frame(spark, clean_names(rows[0]), [[c or None for c in (r + [None] * width)[:width]] for r in rows[1:]]))
        else:
            raise InputError(f"'{name}' is not a CSV, TSV, JSON, Excel or Parquet file.")
    except InputError:
        raise
    except xlsx.WorkbookError as e:
        raise InputError(str(e)) from e
    except Exception as e:
        raise InputError(f"'{name}' could not be read as {kind}. The file may be damaged or in another format.") from e
    columns = [c for c in df.columns if c != ROW]
    return Dataset(name, path, kind, df, columns, chosen, verdict, warnings)
