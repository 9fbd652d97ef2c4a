"""Personal data in text: find, mask, pseudonyms. Everything is an expression; no Python runs for a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritab.functions.spans import either, found, let

#: Kinds of the driver's documents, with patterns that Python, Java and RE2 read alike.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "card": r"\b[0-9]{16}\b",
    "phone": r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}",
}
_MONTHS = "janeiro|fevereiro|março|marco|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro"
#: The nine kinds of personal data of project texts. A number inside a longer one is none.
PERSONAL = {
    "email": r"(?U)[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
    "nif": r"(?<!\d)(?<!\d[.,])\d{9}(?!\d|[.,]\d)",
    "cc": r"(?iu)\b\d{8}\s?\d\s?[A-Z]{2}\d\b|\bC\.?\s?C\.?\s*(?:n\.?º\s*)?:?\s*\d{6,9}\b",
    "phone": r"(?<!\d)(?<!\d[.,])(?:\+351\s?)?[29]\d{2}\s?\d{3}\s?\d{3}(?!\d|[.,]\d)",
    "postal_code": r"(?<!\d)(?<!\d[.,])\d{4}\s?[-\u2013]\s?\d{3}(?!\d|[.,]\d)",
    "dgeg_oet": r"(?i)\b(?:OET|DGEG|OE)\b\D{0,25}?\d{3,}",
    "address": r"(?U)\b(?:Rua|Avenida|Av\.|Travessa|Largo|Praça|Estrada|Alameda|Urbanização)\s+(?:d[aeo]s?\s+)?[A-ZÀ-Ý0-9][\w.º-]*",
    "date": rf"(?iu)\b\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{2,4}}\b|\b(?:{_MONTHS})\s*(?:de\s*|/\s*|\|\s*)?\d{{4}}\b",
    "verification_code": r"(?iu)c[oó]digo de verifica[cç][aã]o\D{0,60}?[0-9a-f]{6,}",
}
#: Cheap patterns that stand in every text where the kind does: texts without them are not searched for it.
GATES = {"email": "@", "nif": r"\d{9}", "cc": r"\d{6}", "phone": r"[29]\d{2}\s?\d{3}\s?\d{3}", "postal_code": r"\d{4}\s?[-\u2013]", "dgeg_oet": r"\d{3}", "date": r"\d[/.-]\d|\d{4}"}
#: Kinds that few texts hold: where none of their gates is met, a text is searched for the other kinds only. A month ends in o or l.
RARE = {k: GATES[k] for k in ("nif", "cc", "phone", "postal_code")} | {"date": r"\d[/.-]\d|(?i:[ol])\s*(?:(?i:de)\s*|/\s*|\|\s*)?\d{4}"}
MARK = "•••"
#: Boxes of Portugal (latitude from and to, longitude west from and to).
BOXES = ((36.8, 42.3, 6.0, 9.7), (36.8, 39.8, 24.8, 31.5), (32.3, 33.2, 16.2, 17.4), (29.9, 30.3, 15.8, 16.1))
#: Known values shorter than this are not masked: too many words would go.
LEAST_KNOWN = 3


def personal(text: Column, patterns: dict[str, str] = PERSONAL) -> Column:
    """Hits (start, less: minus stop, rank of the kind, stop, kind, text) by start, the longest first."""


    def of(rank: int, kind: str):
        return lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("less"), F.lit(rank).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind"), s["text"].alias("text"))

    return F.sort_array(F.concat(*[F.transform(found(text, p, gate=GATES.get(k) if patterns is PERSONAL else None), of(r, k)) for r, (k, p) in enumerate(patterns.items())]))


def masked(text: Column, patterns: dict[str, str] = PERSONAL) -> Column:
    """The text with its hits replaced by a mark, from left to right without overlaps, in one pass.

    Where two kinds begin at one place the one that is told first is taken: long forms stand before short ones.
    """
    long = ["cc", "verification_code", "dgeg_oet", "phone"]
    order = sorted(patterns, key=lambda k: long.index(k) if k in long else len(long))
    without = lambda kinds: F.regexp_replace(text, either([patterns[k] for k in order if k not in kinds]), F.lit(MARK))
    if patterns is not PERSONAL:
        return without(())
    return F.when(text.rlike("|".join(RARE.values())), without(())).otherwise(without(RARE))


def masked_known(text: Column, values: Column) -> Column:
    """Known values of the row masked first, the longest first, with any blanks between their words; then the patterns.

    ``values`` is an array of texts; those shorter than LEAST_KNOWN and nulls are left out. Case does not count.
    """
    tidy = F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: F.trim(F.regexp_replace(v, r"\s+", " ")))
    long = F.array_sort(F.filter(tidy, lambda v: F.length(v) >= LEAST_KNOWN), lambda a, b: F.length(b) - F.length(a))
    quoted = F.transform(long, lambda v: F.concat(F.lit(r"\Q"), F.replace(v, F.lit(" "), F.lit(r"\E\s*\Q")), F.lit(r"\E")))
    pattern = F.concat(F.lit(r"(?iuU)(?<!\w)(?:"), F.array_join(quoted, "|"), F.lit(r")(?!\w)"))
    known = F.when(F.size(quoted) > 0, F.regexp_replace(text, pattern, F.lit(MARK))).otherwise(text)
    return let(known, lambda t: masked(t))


def guard_findings(text: Column, folded: Column, terms: Column, least: int = 4) -> Column:
    """Kinds of personal data in a text: patterns on the text without placeholders, known terms on the folded text.

    ``terms`` is an array of (kind, value), values folded. What was found is never part of the answer.
    """
    bare = F.regexp_replace(text, r"\{\{v:[a-z0-9_.]+\}\}", " ")
    by_pattern = let(bare, lambda t: F.transform(personal(t), lambda h: h["kind"]))
    padded = F.concat(F.lit(" "), F.regexp_replace(folded, r"(?U)\W+", " "), F.lit(" "))
    hit = F.filter(terms, lambda t: (F.length(t["value"]) >= least) & padded.contains(F.concat(F.lit(" "), F.trim(F.regexp_replace(t["value"], r"(?U)\W+", " ")), F.lit(" "))))
    return F.array_sort(F.array_distinct(F.concat(by_pattern, F.transform(hit, lambda t: t["kind"]))))


def in_portugal(lat: Column, lon: Column) -> Column:
    inside = F.lit(False)
    for a, b, c, d in BOXES:
        inside = inside | (F.abs(lat).between(a, b) & F.abs(lon).between(c, d))
    return inside


def like_digits(template: Column, digits: Column) -> Column:
    """``digits`` in the digit places of ``template``, its other characters kept; the digits alone if the counts differ."""
    want = F.length(F.regexp_replace(template, "[^0-9]", ""))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(acc["out"], F.when(digit, digits.substr(acc["at"], F.lit(1))).otherwise(c)).alias("out"), (acc["at"] + digit.cast("int")).alias("at"))

    filled = F.aggregate(F.split(template, ""), start, step)["out"]
    return F.when(want == F.length(digits), filled).otherwise(digits)


def like_case(template: Column, text: Column) -> Column:
    """``text`` in upper or lower case if all letters of ``template`` are."""
    bare = F.regexp_replace(template, r"[^\p{L}]", "")
    return F.when((bare != "") & (bare == F.upper(bare)), F.upper(text)).when((bare != "") & (bare == F.lower(bare)), F.lower(text)).otherwise(text)


def check_digit(first8: Column) -> Column:
    """The ninth digit, modulo 11, of a tax number."""
    s = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.lit(0), lambda acc, i: acc + (10 - i) * first8.substr(i, F.lit(1)).cast("int"))
    return F.when(s % 11 < 2, 0).otherwise(11 - s % 11)


def pseudonym(kind: Column, real: Column, n: Column) -> Column:
    """The n-th pseudonym of a kind in a reserved format, written in the style of the real value.

    Tax numbers get a check digit that is wrong on purpose, postal codes the area 0000, mail the reserved domain.
    """
    three = F.lpad(n.cast("string"), 3, "0")
    first8 = F.concat(F.lit("99999"), three)
    nif = like_digits(F.trim(real), F.concat(first8, ((check_digit(first8) + 1) % 10).cast("string")))
    prefix = F.regexp_extract(real, r"^(\s*(?:\+|00)351[ .\u00a0]?)", 1)
    national = real.substr(F.length(prefix) + 1, F.length(real))
    lead = F.regexp_extract(national, r"^\D*([29])", 1)
    phone = F.concat(prefix, like_digits(national, F.concat(F.when(lead == "", "9").otherwise(lead), F.lit("0000"), F.lpad(n.cast("string"), 4, "0"))))
    mail = F.concat(F.lit("pessoa"), three, F.lit("@example.com"))
    address = like_case(real, F.concat(F.lit("Rua Exemplo "), n.cast("string")))
    other = F.concat(F.lit("[DADO "), n.cast("string"), F.lit("]"))
    return F.when(kind == "email", mail).when(kind == "nif", nif).when(kind == "phone", phone).when(kind == "postal_code", F.concat(F.lit("0000-"), three)).when(kind == "address", address).otherwise(other)


def in_bytes(content: Column, value: Column) -> Column:
    """Whether raw bytes hold a text in an 8-bit or a 16-bit decoding."""
    raw = F.decode(content, "ISO-8859-1")  # one character a byte
    return raw.contains(value) | raw.contains(F.decode(F.encode(value, "UTF-16LE"), "ISO-8859-1"))
