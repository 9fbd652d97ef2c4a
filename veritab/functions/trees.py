"""Texts of document trees: JSON nodes of a fixed depth (document, block, paragraph, run)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritab.functions.spans import let

_RUN = "struct<type:string,text:string>"
_PARAGRAPH = f"struct<type:string,text:string,content:array<{_RUN}>>"
_BLOCK = f"struct<type:string,text:string,content:array<{_PARAGRAPH}>>"
DOCUMENT = f"struct<type:string,content:array<{_BLOCK}>>"


def _own(node: Column) -> Column:
    return F.when(node["type"] == "text", F.coalesce(node["text"], F.lit(""))).otherwise("")


def _inside(node: Column, below) -> Column:
    return F.concat(_own(node), F.coalesce(F.array_join(F.transform(node["content"], below), ""), F.lit("")))


def _paragraph(p: Column) -> Column:
    return _inside(p, _own)


def _block(b: Column) -> Column:
    return _inside(b, _paragraph)


def plain_text(json: Column) -> Column:
    """All text of a tree; null if it is no tree."""
    tree = F.from_json(json, DOCUMENT)
    body = let(tree, lambda t: F.coalesce(F.array_join(F.transform(t["content"], _block), ""), F.lit("")))
    return F.when(json.rlike(r"^\s*\{"), body)


def blocks(json: Column) -> Column:
    """The paragraphs of a tree, those of locked blocks one by one; pending blocks stay out."""
    tree = F.from_json(json, DOCUMENT)
    each = lambda b: F.when(b["type"] == "locked", F.coalesce(F.transform(b["content"], _paragraph), F.array().cast("array<string>"))).otherwise(F.array(_block(b)))
    live = let(tree, lambda t: F.coalesce(F.flatten(F.transform(F.filter(t["content"], lambda b: b["type"] != "pending"), each)), F.array().cast("array<string>")))
    return F.when(json.rlike(r"^\s*\{"), live)
