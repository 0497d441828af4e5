"""Spreadsheets (.xlsx) read where they lie: each file is one task that goes through the first sheet's rows one by one."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The format's names, its built-in date formats, and the day that dates are counted from.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
ZERO_DAYS = {False: datetime.datetime(1899, 12, 30), True: datetime.datetime(1904, 1, 1)}
#: Rows that leave a task together.
ROWS = 1000


def column_number(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def said(node: ElementTree.Element) -> str:
    """The text of a cell or of a shared string, phonetic guides left out."""
    return "".join(t.text or "" for part in node if part.tag in (f"{MAIN}t", f"{MAIN}r") for t in ([part] if part.tag == f"{MAIN}t" else part.iter(f"{MAIN}t")))


def is_date(code: str) -> bool:
    bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code)
    return bool(re.search(r"[dmyhs]", bare, re.I)) and "General" not in code


class Book:
    """A workbook's first sheet: where it is, its shared strings, which styles are dates."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        names = set(self.zip.namelist())
        root = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        sheet = root.find(f"{MAIN}sheets")[0].get(LINK)
        links = ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))
        target = next(x.get("Target") for x in links if x.get("Id") == sheet)
        self.sheet = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        of = root.find(f"{MAIN}workbookPr")
        self.zero = ZERO_DAYS[of is not None and of.get("date1904") in ("1", "true")]
        self.strings = [said(x) for x in ElementTree.fromstring(self.zip.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        self.dates: set[str] = set()
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
            own = {int(x.get("numFmtId")): is_date(x.get("formatCode", "")) for x in styles.iter(f"{MAIN}numFmt")}
            formats = styles.find(f"{MAIN}cellXfs")
            for i, x in enumerate(formats if formats is not None else ()):
                n = int(x.get("numFmtId", "0"))
                if own.get(n, n in DATE_FORMATS):
                    self.dates.add(str(i))

    def value(self, cell: ElementTree.Element) -> str | None:
        """A cell's value as text: true or false, dates in ISO form, whole numbers without a point, errors as null."""
        kind, v = cell.get("t", "n"), cell.find(f"{MAIN}v")
        if kind == "inlineStr":
            return said(cell.find(f"{MAIN}is"))
        if v is None or v.text is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(v.text)]
        if kind == "b":
            return "true" if v.text.strip() in ("1", "true") else "false"
        if kind != "n":
            return v.text
        number = float(v.text)
        if cell.get("s") in self.dates:
            when = self.zero + datetime.timedelta(microseconds=round(number * 86_400_000) * 1000)
            return when.isoformat(sep=" ")
        return str(int(number)) if number == int(number) and abs(number) < 1e15 else repr(number)

    def rows(self) -> Iterator[tuple[int, list[str | None]]]:
        """(row number, cells): rows without cells are left out, cells that are not there are null."""
        with self.zip.open(self.sheet) as stream:
            n = 0
            for _, row in ElementTree.iterparse(stream):
                if row.tag != f"{MAIN}row":
                    continue
                n = int(row.get("r", n + 1))
                cells: list[str | None] = []
                for cell in row.iter(f"{MAIN}c"):
                    at = column_number(cell.get("r", "")) if cell.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = self.value(cell)
                row.clear()
                if any(c is not None for c in cells):
                    yield n, cells


def sheet_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, cells array<string>): the rows of the first sheet of one file, or of every file of a folder."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held: list = []
                for n, cells in Book(data.as_py()).rows():
                    held.append((n, cells))
                    if len(held) == ROWS:
                        yield told(name, held)
                        held = []
                if held:
                    yield told(name, held)

    def told(name: str, held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name] * len(held)), pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.list_(pa.string()))], ["path", "row", "cells"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    return files.mapInArrow(read, "path string, row long, cells array<string>")


def named(header: list[str | None]) -> list[str]:
    """Column names: an empty one by its number, a repeated one with a count."""
    out: list[str] = []
    for i, h in enumerate(header):
        name, n = h if h not in (None, "") else f"Unnamed: {i}", 0
        while (name if not n else f"{name}.{n}") in out:
            n += 1
        out.append(name if not n else f"{name}.{n}")
    return out


def typed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each text column as boolean, bigint, double or timestamp where all of its values are; one aggregation decides."""
    iso = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?$"
    tests = {"boolean": r"^(true|false)$", "bigint": r"^-?\d{1,18}$", "double": r"^-?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^(nan|-?inf)$", "timestamp_ntz": iso}
    aggs = [F.bool_and(F.col(f"`{c}`").rlike(t)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, t in tests.items()]
    fits = df.agg(*aggs).first() if columns else {}
    kinds = {c: next((k for k in tests if fits[f"{k}{i}"]), None) for i, c in enumerate(columns)}
    return df.withColumns({c: F.col(f"`{c}`").try_cast(k) for c, k in kinds.items() if k})  # headers may be cast before they are left out


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet under its first row as header, columns typed by their values. Files of a folder have one header,
    that of the first by name; a column that a file lacks is null. Rows are read in tasks, only the header comes to the driver."""
    rows = sheet_rows(spark, path)
    heads = rows.groupBy("path").agg(F.min_by("cells", "row").alias("head"), F.min("row").alias("first"))
    head = heads.orderBy("path").first()
    if head is None:
        return spark.createDataFrame([], "value string").drop("value")
    names = named(head["head"])
    width = rows.agg(F.max(F.size("cells"))).first()[0]
    names = named([*names, *[None] * (width - len(names))])
    body = rows.join(heads.select("path", "first"), "path").where("row > first").orderBy("path", "row")
    return typed(body.select(*[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(names)]), names)
