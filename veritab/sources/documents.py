"""Paragraphs of .docx files, read where the files are."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{W}t"))


def paragraphs_of(data: bytes) -> list[tuple[str, str]]:
    """(kind, text) of the body: paragraphs, and table rows as their different cells in order, joined by `` | ``."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    out = []
    for node in body if body is not None else ():
        if node.tag == f"{W}p":
            out.append(("paragraph", _text(node).strip()))
        elif node.tag == f"{W}tbl":
            for row in node.iter(f"{W}tr"):
                cells = [" ".join(filter(None, (_text(p).strip() for p in c.iter(f"{W}p")))) for c in row.findall(f"{W}tc")]
                out.append(("row", " | ".join(dict.fromkeys(filter(None, cells)))))
    return [(k, t) for k, t in out if t]


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, kind, text, note); a file that cannot be read gives one row with a note, no error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, data in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [(p, i, k, t, None) for i, (k, t) in enumerate(paragraphs_of(data))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows.append((p, 0, None, None, f"unreadable: {type(e).__name__}"))
            yield pd.DataFrame(rows, columns=["path", "ord", "kind", "text", "note"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, ord long, kind string, text string, note string")
