"""Readings merged into a stored draft, one after another: nothing is chosen by majority or date."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

READINGS = "key string, seq long, kind string, source string, read array<struct<form:string,value:string>>"
STEPS = "key string, seq long, action string, value string, status string, source string, candidates string"
_STEPS = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in STEPS.split(", ")])


def step(draft: dict | None, kind: str, source: str | None, read: list[dict]) -> tuple[dict | None, str]:
    """(draft after one reading or decision, what it did).

    A draft has value, form, status, source, and open candidates (none: no conflict). Kinds: ``read`` with the forms
    that a source reads; ``choose`` closes a conflict with the last candidate of ``source``, or its first candidate if
    that is null; ``manual`` closes it, or sets the value, by hand. Actions: new, replace, agree, conflict, joined,
    closed, refused.
    """
    found = [{"source": source, **r} for r in read]
    if kind != "read":
        open_ = draft["open"] if draft else []
        fit = [c for c in open_ if c["source"] == source][-1:] if source is not None else open_[:1]
        pick = fit if kind == "choose" else [{"source": "manual", **r} for r in read[-1:]]
        if not pick:
            return draft, "refused"
        return {**pick[0], "status": "pending", "open": []}, "closed"
    if not found:
        return draft, "agree"
    if draft is None:
        if len(found) > 1:
            return {"value": None, "form": None, "status": "conflict", "source": source, "open": found}, "conflict"
        return {**found[0], "status": "pending", "open": []}, "new"
    if draft["open"]:
        return {**draft, "open": [c for c in draft["open"] if c["source"] != source] + found}, "joined"
    if len(found) == 1 and draft["source"] == source:
        return {**draft, **found[0]}, "replace"
    if len(found) == 1 and draft["form"] == found[0]["form"]:
        return draft, "agree"
    before = [] if draft["source"] == source else [{k: draft[k] for k in ("source", "form", "value")}]
    return {**draft, "value": None, "form": None, "status": "conflict", "open": before + found}, "conflict"


def told(key: str, seq: int, draft: dict | None, action: str) -> tuple:
    d = draft or {"value": None, "status": None, "source": None, "open": []}
    shown = " / ".join(f"{c['source']}={c['value']}" for c in d["open"]) or None
    return key, seq, action, d["value"], d["status"], d["source"], shown


def readings(rows: DataFrame) -> DataFrame:
    """(key, seq, kind, source, form, value) -> one row per (key, seq, kind, source); of one form the greatest value stays."""
    one = rows.groupBy("key", "seq", "kind", "source", "form").agg(F.max("value").alias("value"))
    return one.groupBy("key", "seq", "kind", "source").agg(F.array_sort(F.collect_list(F.when(F.col("form").isNotNull(), F.struct("form", "value")))).alias("read"))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, draft = None, None
    for b in batches:
        out = []
        for key, seq, kind, source, read in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != now:
                now, draft = key, None
            draft, action = step(draft, kind, source, read or [])
            out.append(told(key, seq, draft, action))
        cols = list(zip(*out, strict=True)) or [()] * len(_STEPS)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _STEPS.types, strict=True)], schema=_STEPS)


def merged_in_order(rows: DataFrame) -> DataFrame:
    """(key, seq, action, value, status, source, candidates): the draft after each reading of :func:`readings`.

    The result depends on the order of ``seq`` (ties: kind, source), so the readings of a key are walked one after
    another, in sorted partitions and with one draft in memory; a key of any length needs no more. Rows with a null
    key are left out, a null ``read`` is empty.
    """
    one = rows.filter("key is not null").select("key", "seq", "kind", "source", "read")
    return one.repartition("key").sortWithinPartitions("key", "seq", "kind", "source").mapInArrow(_walk, STEPS)

