"""Places of pattern matches inside texts, by built-in functions: no Python runs for a row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,stop:int,text:string>>"


def let(value: Column, then) -> Column:
    """Evaluate ``value`` once per row and hand it to ``then`` as a lambda variable."""
    return F.transform(F.array(value), then)[0]


#: Numbers whose running sums are taken at a time.
RUN = 256


def running(numbers: Column) -> Column:
    """Running sums of an array of whole numbers: in stretches of RUN, then from stretch to stretch, so that no array
    grows by one element a number."""

    def sums(z: Column) -> Column:
        add = lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x)
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(z) - 1, F.lit(0)), F.lit(RUN)), lambda i: F.aggregate(F.slice(z, i + 1, RUN), F.array().cast("array<int>"), add))
        before = let(parts, lambda p: F.aggregate(F.transform(p, lambda x: F.coalesce(F.try_element_at(x, F.lit(-1)), F.lit(0))), F.array(F.lit(0)), add))
        return F.flatten(F.zip_with(parts, let(before, lambda b: F.slice(b, 1, F.size(parts))), lambda x, o: F.transform(x, lambda y: y + o)))

    return let(numbers, sums)


#: Characters that stand around a match, and between it and its group, while places are counted.
EDGE, INNER = "\ue000", "\ue001"


def found(text: Column, pattern: str, group: int = 0, gate: str | None = None) -> Column:
    """Non-overlapping matches from left to right: (start, stop, text of ``group``). Null text: none.

    ``gate`` is a cheaper pattern that is found in every text where ``pattern`` is; others are not searched.

    One pass of the pattern puts marks around each match; a split at the marks gives the matches and what lies between
    them, and lengths give the places. Texts that hold a mark themselves are split at the pattern.
    """

    def lone(p: Column) -> Column:
        start, hit = F.length(p[0]), F.substring_index(p[1], INNER, 1)
        return F.array(F.struct(start.alias("start"), (start + F.length(hit)).alias("stop"), F.substring_index(p[1], INNER, -1).alias("text")))

    def several(hits: Column, gaps: Column, said: Column) -> Column:
        ends = running(F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.length(g) + F.length(h)))
        spans = let(ends, lambda e: F.transform(hits, lambda h, i: F.struct((F.get(e, i) - F.length(h)).alias("start"), F.get(e, i).alias("stop"))))
        return F.zip_with(spans, said, lambda s, t: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), t.alias("text")))

    def parted(p: Column) -> Column:
        inner = F.filter(p, lambda x, i: i % 2 == 1)
        gaps, hits, said = F.filter(p, lambda x, i: i % 2 == 0), F.transform(inner, lambda x: F.substring_index(x, INNER, 1)), F.transform(inner, lambda x: F.substring_index(x, INNER, -1))
        return F.when(F.size(p) == 3, lone(p).cast(SPAN)).otherwise(let(F.struct(hits.alias("h"), gaps.alias("g"), said.alias("s")), lambda v: several(v["h"], v["g"], v["s"])).cast(SPAN))

    none = F.array().cast(SPAN)
    marked = F.regexp_replace(text, pattern, f"{EDGE}$0{INNER}${group}{EDGE}")
    every = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    held = let(every(0), lambda h: several(h, F.split(text, pattern, -1), every(group) if group else h)).cast(SPAN)
    hits = F.when(text.contains(EDGE) | text.contains(INNER), held).otherwise(let(F.split(marked, EDGE, -1), parted))
    return F.coalesce(F.when(text.rlike(gate) & text.rlike(pattern) if gate else text.rlike(pattern), hits), none)


def in_turn(*spans: Column) -> Column:
    """Spans of several arrays by place; those of a later array that begin inside one of an earlier go."""

    def free(k: Column, m: Column) -> Column:
        return F.filter(m, lambda s: ~F.exists(k, lambda t: (t["start"] <= s["start"]) & (s["start"] < t["stop"])))

    kept = spans[0]
    for more in spans[1:]:
        kept = let(F.struct(kept.alias("k"), more.alias("m")), lambda p: F.concat(p["k"], free(p["k"], p["m"])))
    return F.sort_array(kept)


def replaced(text: Column, pattern: str, by) -> Column:
    """``text`` with each match of a pattern replaced by ``by(match)``: what lies between is joined with what comes instead."""
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, hit: F.concat(gap, F.coalesce(F.when(hit.isNotNull(), by(hit)), F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)


def blanked(text: Column, pattern: str) -> Column:
    """Every match as blanks of the same length, so that places stay what they were."""
    return replaced(text, pattern, lambda hit: F.repeat(F.lit(" "), F.length(hit)))


def either(patterns: list[str]) -> str:
    """One pattern that finds what any of them does, from left to right; where two begin at one place, the first of them."""
    return "|".join(re.sub(r"^\(\?([a-zA-Z]+)\)(.*)$", r"(?\1:\2)", p, flags=re.S) if p.startswith("(?") and re.match(r"^\(\?[a-zA-Z]+\)", p) else f"(?:{p})" for p in patterns)


def snippet(text: Column, start: Column, stop: Column, around: int) -> Column:
    """What stands around a span, with an ellipsis where the text goes on and blanks collapsed."""
    left, right = F.greatest(F.lit(0), start - around), F.least(F.length(text), stop + around)
    body = F.trim(text.substr(left + 1, right - left))
    out = F.concat(F.when(left > 0, "…").otherwise(""), body, F.when(right < F.length(text), "…").otherwise(""))
    return F.trim(F.regexp_replace(out, r"\s+", " "))
