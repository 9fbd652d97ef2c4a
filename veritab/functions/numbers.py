"""Number grammars and readings of numbers. The grammars differ on purpose: never unify them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNED = r"^[+-]?\d+(\.\d+)?$"


def _double(text: Column) -> Column:
    return F.when(text.rlike(SIGNED), text.try_cast("double"))


def ingest_number(x: Column) -> Column:
    """With a comma, dots separate thousands and the comma is decimal; else the text as it stands."""
    t = F.trim(x)
    return _double(F.when(t.contains(","), F.translate(F.translate(t, ".", ""), ",", ".")).otherwise(t))


def checked_number(x: Column) -> Column:
    """Dots or blanks separate thousands only if the whole text is grouped by threes; then a comma is decimal."""
    t = F.trim(x)
    grouped = F.translate(F.translate(t, ". ", ""), ",", ".")
    return F.when(t.rlike(r"^[+-]?\d{1,3}([. ]\d{3})+(,\d+)?$"), _double(grouped)).otherwise(_double(F.translate(t, ",", ".")))


def rule_number(x: Column) -> Column:
    """A comma is a decimal point; nothing separates thousands."""
    return _double(F.translate(F.trim(x), ",", "."))


def number_text(x: Column) -> Column:
    """At most four decimals, without trailing zeros, with a decimal comma."""
    fixed = F.format_string("%.4f", x.cast("double"))
    return F.translate(F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", ""), ".", ",")


def places(x: Column) -> Column:
    """Decimals that a number is written with."""
    return F.length(F.regexp_extract(x, r"\.(\d+)$", 1))


def same_reading(a: Column, b: Column, most: int = 2) -> Column:
    """Equal at the precision of the less precise text, ``most`` decimals at most; null if either is no number."""
    p = F.least(places(a), places(b), F.lit(most))
    x, y = a.try_cast("decimal(30,10)"), b.try_cast("decimal(30,10)")
    at = lambda v, k: F.round(v, k).cast("decimal(30,10)")
    return F.when(p == 0, at(x, 0) == at(y, 0)).when(p == 1, at(x, 1) == at(y, 1)).otherwise(at(x, most) == at(y, most))


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) < 1e-9


def three_valued(*ordered: Column) -> Column:
    """``ok`` if the values never fall, ``fail`` if they do, ``na`` if any is null."""
    known, rising = F.lit(True), F.lit(True)
    for c in ordered:
        known = known & c.isNotNull()
    for a, b in zip(ordered, ordered[1:], strict=False):
        rising = rising & (a <= b)
    return F.when(~known, "na").when(rising, "ok").otherwise("fail")


def tax_number_ok(digits: Column) -> Column:
    """Check digit modulo 11 of a nine-digit number."""
    s = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.lit(0), lambda acc, i: acc + (10 - i) * digits.substr(i, F.lit(1)).cast("int"))
    want = F.when(s % 11 < 2, 0).otherwise(11 - s % 11)
    return F.when(digits.rlike(r"^\d{9}$"), want == digits.substr(9, 1).cast("int")).otherwise(False)


def said_number(x: Column) -> Column:
    """Grammar of parameters: the word ``uma`` is 1; a comma is a decimal point; nothing separates thousands."""
    t = F.lower(F.trim(x))
    return F.when(t == "uma", F.lit(1.0)).otherwise(_double(F.translate(t, ",", ".")))


def grouped_number(x: Column) -> Column:
    """Grammar of comparisons of entries: thousands in groups of three by dots or blanks, decimals after a comma only."""
    t = F.trim(x)
    return F.when(t.rlike(r"^[+-]?(?:\d{1,3}(?:[. ]\d{3})+|\d+)(?:,\d+)?$"), _double(F.translate(F.translate(t, ". ", ""), ",", ".")))


def minutes(seconds: Column) -> Column:
    """Time for people: minutes below an hour and a half, else hours; a dash for null."""
    return F.when(seconds.isNull(), "—").when(seconds < 5400, F.concat(F.format_string("%.0f", F.bround(seconds / 60, 0)), F.lit(" min"))).otherwise(F.concat(F.format_string("%.1f", seconds / 3600), F.lit(" h")))


def percent(value: Column) -> Column:
    return F.when(value.isNull(), "—").otherwise(F.concat(F.format_string("%.0f", F.bround(value * 100, 0)), F.lit(" %")))


def same(a: Column, b: Column, folded_a: Column, folded_b: Column) -> Column:
    """Equal as numbers where both are, else equal as folded texts."""
    x, y = checked_number(a), checked_number(b)
    return F.when(x.isNotNull() & y.isNotNull(), close(x, y)).otherwise(folded_a == folded_b)
