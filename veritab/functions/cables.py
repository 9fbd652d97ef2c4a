"""Cable and wire designations in texts: family, geometry, and which may stand for which."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritab.functions.spans import let

#: Families of cables as they are written, the longer before the shorter.
FAMILIES = (
    r"H0[3579]V{1,2}-[UKRF]",
    r"H0[57]RN-F",
    r"F?[XRS]Z1(?:-K)?\s?\((?:AS|fr[ts]\s?,\s?zh)\)",
    r"F?[XRS]Z1(?:-K)?",
    r"LSVAV",
    r"XAV",
    r"RVFV",
    r"RV-?K",
    r"VV-F",
    r"XV-[RU]",
)
#: Short families that other words resemble; they need a geometry, or cables spoken of nearby.
SHORT = ("LXV", "XV", "VAV")
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2212"
_SIZE = r"\d+(?:[.,]\d+)?"
_GEOMETRY = rf"\s*-?\s*(?:\d+\s*\(\s*1\s*[xX]\s*{_SIZE}\s*\)|\d+\s*[xXG]\s*(?:1\s*[xX]\s*)?{_SIZE}|{_SIZE}\s*m?m[2²])"
_NEAR = r"(?:(?<=(?i:\bcabos?\b.{0,20}))|(?=.{0,20}(?i:\bcabos?\b)))"
_LONG = rf"(?i:{'|'.join(FAMILIES)})(?!\w)(?:{_GEOMETRY})?"
_BRIEF = rf"(?:(?i:{'|'.join(SHORT)})(?!\w){_GEOMETRY}|{_NEAR}(?i:{'|'.join(SHORT)})(?!\w))"
PATTERN = rf"(?:\d+\s*[xX]\s*)?(?<![\w-])(?:{_LONG}|{_BRIEF})(?:\s*m?m[2²])?"
#: What every family holds; texts without it name no cable.
_GATE = r"(?i)H0|Z1|VAV|XAV|RV|VV|XV"
_FAMILY = rf"(?i)(?<![\w-])({'|'.join((*FAMILIES, *SHORT))})(?!\w)"


def canonical_family(x: Column) -> Column:
    """One spelling of a family: upper case, ``RV-K``, the fire mark as `` (AS)`` or ``(frt,zh)``."""
    t = F.trim(F.regexp_replace(F.translate(x, DASHES, "-" * len(DASHES)), r"\s+", " "))
    name = F.trim(F.upper(F.regexp_replace(t, r"\s?\(.*\)", "")))
    mark = F.lower(F.regexp_replace(F.regexp_extract(t, r"(?i)\((AS|fr[ts]\s?,\s?zh)\)", 1), r"\s", ""))
    name = F.when(name == "RVK", "RV-K").otherwise(name)
    return F.when(mark == "", name).when(mark == "as", F.concat(name, F.lit(" (AS)"))).otherwise(F.concat(name, F.lit("("), mark, F.lit(")")))


def geometry(raw: Column) -> Column:
    """``5G10``, ``4x1x185``, ``1x10`` of one designation; null if it has none. Decimals with a comma."""
    after = F.regexp_replace(raw, _FAMILY.replace("(?i)", "(?i)^.*?", 1), "")
    grouped, cores, single = (F.regexp_extract(after, p, 0) for p in (rf"^\s*-?\s*\d+\s*\(\s*1\s*[xX]\s*{_SIZE}", rf"^\s*-?\s*\d+\s*[xXG]\s*(?:1\s*[xX]\s*)?{_SIZE}", rf"^\s*-?\s*{_SIZE}(?=\s*m?m[2²])"))
    tidy = lambda c: F.translate(F.regexp_replace(F.regexp_replace(c, r"^\s*-", ""), r"[\s(]", ""), "X.", "x,")
    inner = F.regexp_replace(tidy(grouped), r"^(\d+)1x", "$1x1x")
    before = F.regexp_extract(raw, r"^(\d+)\s*[xX]\s*", 1)
    alone = F.concat(F.when(before == "", "1").otherwise(before), F.lit("x"), tidy(single))
    return F.when(grouped != "", inner).when(cores != "", tidy(cores)).when(single != "", alone)


def designations(text: Column) -> Column:
    """(raw, family, geometry) of every designation of a text."""
    clean = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), DASHES, "-" * len(DASHES)), r"\s+", " "))
    each = lambda m: F.struct(F.trim(m).alias("raw"), canonical_family(F.regexp_extract(m, _FAMILY, 1)).alias("family"), geometry(F.trim(m)).alias("geometry"))
    named = lambda t: F.transform(F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0)), each)
    return F.when(text.rlike(_GATE), let(clean, named)).otherwise(let(F.lit(""), named))


def kind(family: Column) -> Column:
    """``fio`` for single-core building wires, else ``cabo``."""
    return F.when(family.rlike(r"^H0\dV-"), "fio").otherwise("cabo")


def base(family: Column) -> Column:
    """The family without its fire mark and without the letter that tells rigid from flexible."""
    return F.regexp_replace(F.upper(F.trim(F.split(family, r"\(")[0])), r"-[UKRF]$", "")


def flexible(family: Column) -> Column:
    """True for flexible, false for rigid, null if the name does not tell."""
    name = F.upper(F.trim(F.split(family, r"\(")[0]))
    return F.when(name.rlike(r"-[KF]\b") | name.isin("RV-K", "RVFV"), True).when(name.rlike(r"-[UR]\b"), False)


def may_be_equivalent(a: Column, b: Column) -> Column:
    """Different names of one kind, never one rigid and one flexible."""
    apart = F.coalesce(flexible(a) != flexible(b), F.lit(False))
    return (a != b) & ~apart & (kind(a) == kind(b))
