"""Dates as ISO text: months and days are compared as strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Portuguese month names, without accents.
MONTHS = ("janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")


def month_year(x: Column) -> Column:
    """``mm/yyyy``, ``mm/yy``, or a month word and a year -> ``yyyy-mm``; else null."""
    t = F.translate(F.lower(x), "ç", "c")
    m, y = F.regexp_extract(t, r"^\s*(\d{1,2})/(\d{4}|\d{2})\s*$", 1), F.regexp_extract(t, r"^\s*(\d{1,2})/(\d{4}|\d{2})\s*$", 2)
    by_number = F.when(m.try_cast("int").between(1, 12), F.concat(F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y), F.lit("-"), F.lpad(m, 2, "0")))
    pattern = rf"({'|'.join(MONTHS)})\s+(?:de\s+)?(\d{{4}})"
    word, year = F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2)
    place = F.array_position(F.array(*[F.lit(w) for w in MONTHS]), word)
    return F.coalesce(by_number, F.when(place > 0, F.concat(year, F.lit("-"), F.lpad(place.cast("string"), 2, "0"))))


def shown_date(iso: Column) -> Column:
    """ISO day -> dd/mm/yyyy, ISO month -> month word and year."""
    word = F.element_at(F.array(*[F.lit(w) for w in MONTHS]), iso.substr(6, 2).try_cast("int"))
    return F.when(F.length(iso) == 10, F.array_join(F.reverse(F.split(iso, "-")), "/")).when(F.length(iso) == 7, F.concat_ws(" de ", word, iso.substr(1, 4)))


def is_old(issued: Column, years: int, today: Column) -> Column:
    """Older than ``years`` years; an unknown date is not old."""
    return F.coalesce(F.add_months(issued, 12 * years) < today, F.lit(False))


#: Month names of issue dates, folded, in three languages, by number.
ISSUE_MONTHS = {
    1: ("janeiro", "january", "enero", "jan"), 2: ("fevereiro", "february", "febrero", "feb"), 3: ("marco", "march", "mar"), 4: ("abril", "april", "apr"),
    5: ("maio", "may", "mayo"), 6: ("junho", "june", "jun"), 7: ("julho", "july", "jul"), 8: ("agosto", "august", "aug"),
    9: ("setembro", "september", "septiembre", "sep"), 10: ("outubro", "october", "octubre", "oct"), 11: ("novembro", "november", "noviembre", "nov"), 12: ("dezembro", "december", "diciembre", "dec"),
}
_NAMES = "|".join(sorted((n for v in ISSUE_MONTHS.values() for n in v), key=len, reverse=True))
_DATE = rf"\d{{4}}-\d{{2}}(?:-\d{{2}})?|\d{{4}}[/.]\d{{2}}[/.]\d{{2}}|\d{{1,2}}[/.]\d{{1,2}}[/.]\d{{4}}|\d{{1,2}}[/.]\d{{4}}|(?:{_NAMES})\.?\s*(?:de\s+)?\d{{4}}"
_ISSUE = rf"\b(?:rev(?:\.|isao|ision)?|edicao|edition|data|date|version|versao|fecha|actualizad[oa]|updated|issued?)(?![a-z])\W{{0,12}}(?:[a-z.]{{1,6}}\W{{1,4}})?({_DATE})"


def to_date(raw: Column) -> Column:
    """A written date as a day, the first of the month where no day is told; null if it is no date."""
    part = lambda p, i: F.nullif(F.regexp_extract(raw, p, i), F.lit(""))
    by_year, by_day, by_month, by_name = r"^(\d{4})[-/.](\d{2})(?:[-/.](\d{2}))?$", r"^(\d{1,2})[/.](\d{1,2})[/.](\d{4})$", r"^(\d{1,2})[/.](\d{4})$", r"^([a-z]+)\.?\s*(?:de\s+)?(\d{4})$"
    names = F.create_map(*[F.lit(x) for m, v in ISSUE_MONTHS.items() for n in v for x in (n, m)])
    iso = F.coalesce(
        F.concat_ws("-", part(by_year, 1), part(by_year, 2), F.coalesce(part(by_year, 3), F.lit("01"))),
    )
    of = lambda y, m, d: F.when(y.isNotNull() & m.isNotNull(), F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))
    text = F.coalesce(
        F.when(raw.rlike(by_year), iso),
        of(part(by_day, 3), part(by_day, 2), part(by_day, 1)),
        of(part(by_month, 2), part(by_month, 1), F.lit("1")),
        of(part(by_name, 2), F.try_element_at(names, F.regexp_extract(raw, by_name, 1)).cast("string"), F.lit("1")),
    )
    return F.try_to_date(text, "yyyy-MM-dd")


def issue_date(folded: Column) -> Column:
    """The first valid date after a dating word of a folded text; invalid ones are passed over."""
    days = F.transform(F.regexp_extract_all(folded, F.lit(_ISSUE), F.lit(1)), to_date)
    return F.try_element_at(F.filter(days, lambda d: d.isNotNull()), F.lit(1))
