"""Workbooks and price files as tables."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cells import CELLS

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def workbook_cells(name: str, data: bytes) -> Iterator[tuple]:
    """(file, sheet, row, col, text) of every filled cell of an .xlsx workbook."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(_MAIN + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_MAIN + "sheet"):
            path = targets[sheet.get(_REL)].lstrip("/")
            path = path if path.startswith("xl/") else f"xl/{path}"
            for c in ElementTree.fromstring(z.read(path)).iter(_MAIN + "c"):
                letters, row = re.match(r"([A-Z]+)(\d+)", c.get("r")).groups()
                col = 0
                for letter in letters:
                    col = col * 26 + ord(letter) - 64
                value = c.find(_MAIN + "v")
                text = "".join(t.text or "" for t in c.iter(_MAIN + "t")) if c.get("t") == "inlineStr" else None if value is None else shared[int(value.text)] if c.get("t") == "s" else value.text
                if text:
                    yield name, sheet.get("name"), int(row) - 1, col - 1, text


def files(spark: SparkSession, folder: str, recursive: bool = True, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of price files, without lock files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(folder)
    base = F.element_at(F.split("path", "/"), -1)
    return found.filter(~base.startswith("~$") & ~base.startswith("%7E$") & (F.lower(base) != ".ds_store"))


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of all .xlsx workbooks in a folder; a file that can't be read gives no cells."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    found = list(workbook_cells(path.rsplit("/", 1)[-1], content))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    found = []
                yield pd.DataFrame(found, columns=["file", "sheet", "row", "col", "text"])

    return files(spark, folder, pattern="*.xls[xm]").select("path", "content").mapInPandas(read, CELLS)


def kinds(found: DataFrame) -> DataFrame:
    """(path, kind): file types by their first bytes."""
    head = F.hex(F.substring("content", 1, 4))
    return found.select("path", F.when(head == "25504446", "pdf").when(head.startswith("504B"), "zip").when(head == "D0CF11E0", "xls").otherwise("other").alias("kind"))


def text_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file, page, line_no, line) of text exports of price lists; a form feed starts a page."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    pages = raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.posexplode(F.split(F.decode("content", "UTF-8"), "\f")).alias("page", "body"))
    return pages.select("file", "page", F.posexplode(F.split("body", r"\r?\n")).alias("line_no", "line"))
