"""Cells of .xlsx files, read where the files are, one task per group of files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def cells_of(data: bytes) -> list[tuple[str, str, int, str]]:
    """(sheet, cell reference, row, value) of every filled cell, in reading order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
            root = ElementTree.fromstring(z.read("xl/" + targets[sheet.get(LINK)].removeprefix("/xl/")))
            for c in root.iter(f"{MAIN}c"):
                value = c.findtext(f"{MAIN}v")
                if c.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                if value not in (None, ""):
                    out.append((sheet.get("name"), c.get("r"), int(re.sub(r"\D", "", c.get("r"))), value))
        return out


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, ref, row, value, ord, note); a file that cannot be read gives one row with a note, no error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, data in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [(p, *c, i, None) for i, c in enumerate(cells_of(data))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError) as e:
                    rows.append((p, None, None, None, None, 0, f"unreadable: {type(e).__name__}"))
            yield pd.DataFrame(rows, columns=["path", "sheet", "ref", "row", "value", "ord", "note"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, sheet string, ref string, row int, value string, ord long, note string")


def form_values(cells: DataFrame, cell_map: DataFrame) -> DataFrame:
    """Read fixed cells: ``cell_map`` (version, version_ref, ref, key) is chosen by what the version cell starts with."""
    which = cells.join(F.broadcast(cell_map.select("version", "version_ref").distinct()), F.col("ref") == F.col("version_ref"))
    which = which.filter(F.col("value").startswith(F.col("version"))).select("path", "version").distinct()
    wanted = which.join(F.broadcast(cell_map.drop("version_ref")), "version")
    return wanted.join(cells, ["path", "ref"], "left").select("path", "version", "key", F.expr("nullif(trim(value), '')").alias("value"))
