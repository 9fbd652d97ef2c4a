"""Sequences of decisions: each sees what the former left, and is taken or refused with a reason."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Machine = Callable[[dict | None, dict], tuple[dict, str | None, dict]]


def issue(state: dict | None, d: dict) -> tuple[dict, str | None, dict]:
    """ignore (with a note), reopen, fix; an issue begins open."""
    now = state or {"status": "open", "note": None}
    why = None
    if d["action"] == "ignore":
        why = "not open" if now["status"] != "open" else "no note" if not d["arg"] else None
        after = {"status": "ignored", "note": d["arg"]}
    elif d["action"] == "fix":
        why = "not open" if now["status"] != "open" else None
        after = {"status": "fixed", "note": None}
    elif d["action"] == "reopen":
        why = "open" if now["status"] == "open" else None
        after = {"status": "open", "note": None}
    else:
        why, after = "unknown", now
    now = now if why else after
    return now, why, {"status": now["status"], "detail": now["note"]}


def revision(state: dict | None, d: dict) -> tuple[dict, str | None, dict]:
    """read (``arg`` "conflict" opens one), resolve, confirm: a reading after a confirmation opens the next revision.

    A revision is confirmed without open conflicts only, and the one that was confirmed before is superseded.
    """
    now = dict(state or {"n": 0, "status": "none", "open": 0, "confirmed": 0, "superseded": 0})
    why = None
    if d["action"] == "read":
        if now["status"] != "draft":
            now.update(n=now["n"] + 1, status="draft", open=0)
        now["open"] += d["arg"] == "conflict"
    elif d["action"] == "resolve":
        why = "no conflict" if now["status"] != "draft" or not now["open"] else None
        now["open"] -= not why
    elif d["action"] == "confirm":
        why = "no draft" if now["status"] != "draft" else "open conflicts" if now["open"] else None
        if not why:
            now.update(status="confirmed", superseded=now["confirmed"], confirmed=now["n"])
    else:
        why = "unknown"
    return now, why, {"status": now["status"], "detail": f"{now['n']}/{now['confirmed']}/{now['superseded']}/{now['open']}"}


SECTIONS = 3


def document(state: dict | None, d: dict) -> tuple[dict, str | None, dict]:
    """edit and approve sections (by another person than the last editor), then the whole; an edit after that is revision + 1."""
    now = state or {"revision": 1, "status": "draft", "by": [None] * SECTIONS, "done": [False] * SECTIONS}
    now = {**now, "by": list(now["by"]), "done": list(now["done"])}
    why, s = None, d["section"]
    if d["action"] == "edit":
        if now["status"] == "approved":
            now.update(revision=now["revision"] + 1, status="draft")
        now["by"][s], now["done"][s] = d["arg"], False
    elif d["action"] == "approve_section":
        why = "own edit" if now["by"][s] == d["arg"] else "approved" if now["done"][s] else None
        if not why:
            now["done"][s] = True
    elif d["action"] == "approve":
        why = "approved" if now["status"] == "approved" else "sections open" if not all(now["done"]) else None
        if not why:
            now["status"] = "approved"
    else:
        why = "unknown"
    return now, why, {"status": now["status"], "detail": f"{now['revision']}/{sum(now['done'])}"}


def block(state: dict | None, d: dict) -> tuple[dict, str | None, dict]:
    """propose requirements, review them, approve or reject the block: what nobody reviewed follows the block."""
    now = state or {"status": "proposed", "open": 0, "approved": 0, "rejected": 0}
    now = dict(now)
    why = None
    if d["action"] == "require":
        now["open" if now["status"] == "proposed" else now["status"]] += 1
    elif d["action"] == "review":
        why = None if now["open"] else "nothing open"
        if not why:
            now["open"] -= 1
            now[d["arg"]] += 1
    elif d["action"] in ("approved", "rejected"):
        why = d["action"] if now["status"] == d["action"] else None
        if not why:
            now.update({"status": d["action"], "open": 0, d["action"]: now[d["action"]] + now["open"]})
    else:
        why = "unknown"
    return now, why, {"status": now["status"], "detail": f"{now['open']}/{now['approved']}/{now['rejected']}"}


OUT = "key string, seq long, refused string, status string, detail string"
_OUT = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in OUT.split(", ")])


def decided_in_order(decisions: DataFrame, machine: Machine) -> DataFrame:
    """(key, seq, refused, status, detail) of decisions (key, seq, action, arg, section): the state after each.

    Decisions of a key are taken in the order of ``seq`` (ties: action, arg, section), in sorted partitions with one
    state in memory, so a history of any length needs no more. ``refused`` is null for what was done; a refused
    decision changes nothing. Rows with a null key are left out, unknown actions are refused.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            out = []
            for d in b.to_pylist():
                if d["key"] != now:
                    now, state = d["key"], None
                state, why, shown = machine(state, d)
                out.append((d["key"], d["seq"], why, shown["status"], shown["detail"]))
            cols = list(zip(*out, strict=True)) or [()] * len(_OUT)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _OUT.types, strict=True)], schema=_OUT)

    rows = decisions.filter("key is not null").select("key", "seq", "action", "arg", "section")
    return rows.repartition("key").sortWithinPartitions("key", "seq", "action", "arg", "section").mapInArrow(walk, OUT)
