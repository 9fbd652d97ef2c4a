"""Entries against their templates, labelled facts, and expected messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritab.functions.numbers import close, grouped_number, said_number
from veritab.functions.spans import found, let

PLACEHOLDER = r"\{\{v:([a-z0-9_.]+)\}\}"
LEAST_VALUE = 4


def _tidy(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def captured(template: Column, original: Column) -> Column:
    """(key, got) for each placeholder of a template that the text fits between its literal parts; null if it does not fit."""

    def match(p: Column) -> Column:
        keys = F.regexp_extract_all(p["t"], F.lit(PLACEHOLDER), F.lit(1))
        literal = F.transform(F.split(p["t"], PLACEHOLDER, -1), lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E")))
        pattern = F.concat(F.lit("(?s)^"), F.array_join(literal, "(.*?)"), F.lit("$"))
        got = F.transform(keys, lambda k, i: F.struct(k.alias("key"), F.call_function("regexp_extract", p["o"], pattern, i + 1).alias("got")))
        return F.when(F.call_function("rlike", p["o"], pattern), got)

    return let(F.struct(_tidy(template).alias("t"), _tidy(original).alias("o")), match)


def differing(template: Column, original: Column, values: Column) -> Column:
    """(key, got, mine) of captured values that the map ``values`` gives differently or not at all."""
    pairs = F.transform(captured(template, original), lambda c: F.struct(c["key"].alias("key"), c["got"].alias("got"), F.try_element_at(values, c["key"]).alias("mine")))
    return F.filter(pairs, lambda c: c["mine"].isNull() | (_tidy(c["mine"]) != _tidy(c["got"])))


def difference_class(key: Column, got: Column, mine: Column) -> Column:
    """Why two readings of a value differ: by whom it is given, missing, number format, case, or the value itself."""
    number = lambda x: F.coalesce(grouped_number(x), said_number(x))
    return (
        F.when(key == "doc.data", "date")
        .when(key.rlike(r"^(?:tec|doc)\."), "profile")
        .when(mine.isNull(), "missing")
        .when(F.coalesce(close(number(got), number(mine)), F.lit(False)), "number_format")
        .when(F.lower(_tidy(got)) == F.lower(_tidy(mine)), "case")
        .otherwise("value")
    )


def labelled(text: Column, labels: dict[str, str]) -> Column:
    """(key, value) of lines ``label: value``; ``labels`` maps a key to the pattern of its label. Short values are left out."""
    each = [F.transform(found(text, rf"(?imu)^\s*(?:{p})\s*[:\-]\s*(.+?)\s*$", 1), _named(k)) for k, p in labels.items()]
    return F.transform(F.filter(F.sort_array(F.concat(*each)), lambda x: F.length(x["value"]) >= LEAST_VALUE), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))


def _named(key: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(key).alias("key"), s["text"].alias("value"))


def first_brand(text: Column, brands: list[str]) -> Column:
    """The brand that stands first in a text, as the list spells it; null if none does."""
    places = F.array(*[F.struct(F.nullif(F.instr(F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), F.lit(" ")), F.lit(f" {b.lower()} ")), F.lit(0)).alias("at"), F.lit(b).alias("brand")) for b in brands])
    return F.array_min(F.filter(places, lambda p: p["at"].isNotNull()))["brand"]


def case_found(message: Column, words: Column, reading: Column, expected: Column) -> Column:
    """An expected case is found if the message holds all its words and the reading begins as expected."""
    return F.forall(words, lambda w: F.lower(message).contains(F.lower(w))) & reading.startswith(expected)
