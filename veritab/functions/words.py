"""Numbers in words, designations, and names inside texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Portuguese numerals, with the spellings of Portugal and Brazil and both genders.
NUMERALS = {
    "zero": 0, "um": 1, "uma": 1, "dois": 2, "duas": 2, "tres": 3, "quatro": 4, "cinco": 5, "seis": 6, "sete": 7, "oito": 8, "nove": 9, "dez": 10,
    "onze": 11, "doze": 12, "treze": 13, "catorze": 14, "quatorze": 14, "quinze": 15, "dezasseis": 16, "dezesseis": 16, "dezassete": 17, "dezessete": 17, "dezoito": 18, "dezanove": 19, "dezenove": 19,
    "vinte": 20, "trinta": 30, "quarenta": 40, "cinquenta": 50, "sessenta": 60, "setenta": 70, "oitenta": 80, "noventa": 90,
    "cem": 100, "cento": 100, "duzentos": 200, "duzentas": 200, "trezentos": 300, "trezentas": 300, "quatrocentos": 400, "quatrocentas": 400, "quinhentos": 500, "quinhentas": 500,
    "seiscentos": 600, "seiscentas": 600, "setecentos": 700, "setecentas": 700, "oitocentos": 800, "oitocentas": 800, "novecentos": 900, "novecentas": 900,
}
_NUMERAL = "|".join(sorted(NUMERALS, key=len, reverse=True))
_COUNT = rf"(\d+|(?:{_NUMERAL})(?: e (?:{_NUMERAL}))*)"


def words_to_int(folded: Column) -> Column:
    """A folded text of digits, or of numerals with `` e `` between them; any other word makes it null."""
    known = F.create_map(*[F.lit(x) for kv in NUMERALS.items() for x in kv])
    parts = F.transform(F.split(F.trim(folded), r"\s+e\s+"), lambda w: F.try_element_at(known, w))
    total = F.aggregate(parts, F.lit(0), lambda a, b: a + b)  # null as soon as one part is
    return F.coalesce(F.trim(folded).try_cast("int"), total)


def quantity_of(folded: Column, noun: str, container: str) -> Column:
    """How many ``noun`` a folded text counts.

    "N containers with M nouns in each" multiplies; otherwise the first count before the noun is taken, unless the
    words before it say that it counts a subset ("dos quais", "das quais").
    """
    product = rf"\b{_COUNT} {container}s?\b[^.]*?\b{_COUNT} {noun}s?\b[^.]*?\b(?:em cada|por {container}|cada)\b"
    single = rf"(?<!\bd[oa]s quais )\b{_COUNT} {noun}s?\b"
    times = words_to_int(F.regexp_extract(folded, product, 1)) * words_to_int(F.regexp_extract(folded, product, 2))
    return F.coalesce(times, words_to_int(F.regexp_extract(folded, single, 1)))


def sheet_name(file: Column) -> Column:
    """(origin, destination) of a file name, cut at the first hyphen that a letter follows."""
    stem = F.regexp_replace(file, r"\.[A-Za-z0-9]{2,5}$", "")
    pattern = r"^(.*?)\s*-\s*(?=\p{L})(.*)$"
    return F.struct(F.nullif(F.trim(F.regexp_extract(stem, pattern, 1)), F.lit("")).alias("origin"), F.nullif(F.trim(F.regexp_extract(stem, pattern, 2)), F.lit("")).alias("destination"))


def cable_section(x: Column) -> Column:
    """Phase section in mm²: after the last G or x of a geometry, else before mm."""
    geometry = F.regexp_extract(x, r"(?i)\d+\s*(?:x\s*\d+\s*)?[gx]\s*(\d+(?:[.,]\d+)?)", 1)
    plain = F.regexp_extract(x, r"(?i)(\d+(?:[.,]\d+)?)\s*mm", 1)
    return F.translate(F.coalesce(F.nullif(geometry, F.lit("")), F.nullif(plain, F.lit(""))), ",", ".").try_cast("double")


def name_variants(name: Column) -> Column:
    """A person's name whole, as first and last word, and as initial and last word."""
    parts = F.split(F.trim(name), r"\s+")
    first, last = F.element_at(parts, 1), F.element_at(parts, -1)
    several = F.array(F.trim(name), F.concat_ws(" ", first, last), F.concat(F.substring(first, 1, 1), F.lit(". "), last))
    return F.array_distinct(F.when(F.size(parts) > 1, several).otherwise(F.array(F.trim(name))))


def fill_template(template: str, fields: list[str]) -> tuple[Column, Column]:
    """(text, missing): ``{field}`` filled from columns; empty fields stay as marks and are listed."""
    out = F.lit(template)
    for f in fields:
        out = F.replace(out, F.lit("{" + f + "}"), F.coalesce(F.nullif(F.col(f).cast("string"), F.lit("")), F.lit("[" + f + "]")))
    empty = [F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", F.lit(f)) for f in fields if "{" + f + "}" in template]
    return out, F.array_join(F.filter(F.array(*empty), lambda x: x.isNotNull()), ",")
