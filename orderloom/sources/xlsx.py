"""Spreadsheets as rows: Spark lists and reads the files, a small parser takes the first sheet out of each."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column(reference: str) -> int:
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def sheet_rows(content: bytes) -> Iterator[list[str]]:
    """Rows of the first sheet: shared and inline strings as text, gaps as empty texts, rows without any text left out."""
    book = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        for item in ElementTree.parse(book.open("xl/sharedStrings.xml")).getroot():
            shared.append("".join(t.text or "" for t in item.iter(f"{_NS}t")))
    sheets = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    for _, row in ElementTree.iterparse(book.open(sheets[0])) if sheets else ():
        if row.tag != f"{_NS}row":
            continue
        cells: list[str] = []
        for c in row.iter(f"{_NS}c"):
            value, kind = c.find(f"{_NS}v"), c.get("t")
            text = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if kind == "inlineStr" else (value.text or "" if value is not None else "")
            at = _column(c.get("r")) if c.get("r") else len(cells)
            cells += [""] * (at - len(cells)) + [(shared[int(text)] if kind == "s" and text else text).replace("_x000D_", "")]
        row.clear()
        if any(x.strip() for x in cells):
            yield cells


def xlsx_rows(spark: SparkSession, path: str) -> DataFrame:
    """path, row (from 0), cells of all spreadsheets under a path, in whatever store Spark reads; lock files are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path)
    files = files.where(~F.regexp_extract("path", r"([^/]+)$", 1).startswith("~$")).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                rows = list(sheet_rows(content.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))], ["path", "row", "cells"])

    return files.mapInArrow(parse, "path string, row long, cells array<string>")


def with_header(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows of xlsx_rows() as columns: each file's first row is its header, by which the named columns are found; missing ones are null."""
    header = rows.where("row = 0").select("path", F.col("cells").alias("header"))
    joined = rows.where("row > 0").join(header, "path")  # one row a file: the planner broadcasts it where that is small
    return joined.select("path", "row", *[F.get("cells", (F.array_position("header", n) - 1).cast("int")).alias(n) for n in names])
