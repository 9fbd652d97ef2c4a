"""Requirements against offers, three-valued."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritab.functions.spans import found

#: Reaction-to-fire classes from best to worst.
EUROCLASSES = ("A1ca", "A2ca", "B1ca", "B2ca", "Cca", "Dca", "Eca", "Fca")


def class_ok(required: Column, offered: Column) -> Column:
    """IP codes digit by digit, IK codes by number, fire classes by rank; null if not comparable.

    A required digit X is not compared; an offered X where a digit is required says nothing, so neither does the code.
    """
    ip = lambda c, i: F.regexp_extract(c, r"^IP([0-9X])([0-9X])$", i)
    ik = lambda c: F.regexp_extract(c, r"^IK(\d{2})$", 1).try_cast("int")
    rank = lambda c: F.nullif(F.array_position(F.array(*[F.lit(x) for x in EUROCLASSES]), c), F.lit(0).cast("long"))
    known, met, asked = F.lit(True), F.lit(True), F.lit(False)
    for i in (1, 2):
        r, o = ip(required, i), ip(offered, i)
        known = known & ((r == "X") | o.rlike("^[0-9]$"))
        met = met & ((r == "X") | (o.try_cast("int") >= r.try_cast("int")))
        asked = asked | r.rlike("^[0-9]$")
    by_ip = F.when(known & asked, met)
    both = required.startswith("IP") & offered.startswith("IP")
    return F.when(both, by_ip).when(required.startswith("IK") & offered.startswith("IK"), ik(offered) >= ik(required)).otherwise(rank(offered) <= rank(required))


def satisfies(operator: Column, required: Column, offered: Column) -> Column:
    """``>=``, ``<=``, ``=`` on numbers and ``>=class`` on classes; null if the two cannot be compared."""
    r, o = required.try_cast("double"), offered.try_cast("double")
    return F.when(operator == ">=class", class_ok(required, offered)).when(operator == ">=", o >= r).when(operator == "<=", o <= r).when(operator == "=", F.abs(o - r) < 1e-9)


def verdict(checks: Column) -> Column:
    """Verdict of a group of checks: a failure outweighs the unknown, which outweighs what is met."""
    return F.when(F.count_if(checks == "fail") > 0, "fails").when(F.count_if(checks == "na") > 0, "to_confirm").when(F.count_if(checks == "ok") > 0, "meets").otherwise("no_requirement")


_NUM = r"(\d+(?:[.,]\d+)?)"
#: Parameters as texts write them: name -> (unit, kind, pattern whose first group is the value).
PARAMS = {
    "ip_rating": ("", "class", r"(?i)\bIP\s?([0-6X][0-9X])(?!\d)"),
    "ik_rating": ("", "class", r"(?i)\bIK\s?(\d{2})(?!\d)"),
    "icc_ka": ("kA", "number", rf"(?i){_NUM}\s?kA\b"),
    "power_w": ("W", "number", rf"(?i)(?<![\w,.]){_NUM}\s?W(?!\w)"),
    "power_kw": ("kW", "number", rf"(?i)(?<![\w,.]){_NUM}\s?kW(?!\w)"),
    "peak_power_wp": ("Wp", "number", rf"(?<![\w,.]){_NUM}\s?Wp\b"),
    "luminous_flux_lm": ("lm", "number", rf"(?i)(?<![\w,.]){_NUM}\s?lm\b"),
    "color_temperature_k": ("K", "number", r"(?i)(?<![\w,.])(\d{4})\s?K\b"),
    "voltage_v": ("V", "number", r"(?i)(?<![\w,.])(\d{2,4})\s?V(?:\s?(?:AC|DC))?(?!\w)"),
    "detection_range_m": ("m", "number", rf"(?iu)(?:(?:dete[cç][aã]o|alcance|detection\s+(?:range|distance)|rilevamento|portata)\D{{0,25}}?|[º°]\s*max\.?\s*){_NUM}\s?m\b"),
    "detection_angle_deg": ("º", "number", r"(?i)(?<![\w,.])(\d{2,3})\s?[º°](?!\s?C\b)"),
    "efficiency_pct": ("%", "number", rf"(?iu)efici[eê]ncia\D{{0,25}}?{_NUM}\s?%"),
    "autonomy_h": ("h", "number", r"(?i)autonomia\D{0,10}?(\d+(?:[.,]\d+)?|uma)\s?(?:h\b|hora)"),
    "cpr_class": ("", "class", r"(?i)\b(A1ca|A2ca|B1ca|B2ca|Cca|Dca|Eca|Fca)\b"),
    "dimensions_mm": ("mm", "text", r"(?i)(\d+(?:[.,]\d+)?\s?[x×]\s?\d+(?:[.,]\d+)?(?:\s?[x×]\s?\d+(?:[.,]\d+)?)?)\s?mm\b"),
}
#: Cheap patterns that stand in every text where the parameter does: texts without them are not searched for it.
GATES = {
    "icc_ka": r"(?i)\d\s?kA", "power_kw": r"(?i)\d\s?kW", "peak_power_wp": r"\d\s?Wp", "luminous_flux_lm": r"(?i)\d\s?lm", "color_temperature_k": r"(?i)\d\s?K", "voltage_v": r"(?i)\d\s?V",
    "detection_range_m": r"(?iu)\d\s?m", "detection_angle_deg": "[º°]", "efficiency_pct": "%", "cpr_class": r"(?i)\dca|[CDEF]ca", "dimensions_mm": "[x×X]",
}


def _value(name: str, raw: Column) -> Column:
    """A value as one text: codes spelt one way, numbers with a point and without trailing zeros, sizes without blanks."""
    kind = PARAMS[name][1]
    if name == "cpr_class":
        return F.concat(F.upper(F.substring(raw, 1, 1)), F.lower(raw.substr(F.lit(2), F.length(raw))))
    if kind == "class":
        return F.concat(F.lit(name[:2].upper()), F.upper(raw))
    if kind == "text":
        return F.replace(F.regexp_replace(raw, r"\s+", ""), F.lit("×"), F.lit("x"))
    number = F.when(F.lower(raw) == "uma", "1").otherwise(F.translate(raw, ",", "."))
    return F.when(number.contains("."), F.regexp_replace(number, r"\.?0+$", "")).otherwise(F.regexp_replace(number, r"^0+(?=\d)", ""))


def read(text: Column) -> Column:
    """(start, name, value, unit) of all parameters that a text tells of, by place; a name may repeat."""


    def of(name: str) -> Column:
        unit, _, pattern = PARAMS[name]
        return F.transform(found(text, pattern, 1, GATES.get(name)), lambda s: F.struct(s["start"].alias("start"), F.lit(name).alias("name"), _value(name, s["text"]).alias("value"), F.lit(unit).alias("unit")))

    return F.sort_array(F.concat(*map(of, PARAMS)))


def normalize(name: str, raw: Column) -> Column:
    """A value written by a person as :func:`read` would give it; null if it is none."""
    kind, t = PARAMS[name][1], F.trim(raw)
    if kind == "number":
        return F.when(t.rlike(r"^\d+(?:[.,]\d+)?$") | (F.lower(t) == "uma"), _value(name, t))
    if kind == "text":
        return F.nullif(t, F.lit(""))
    own, short = (F.regexp_extract(x, PARAMS[name][2], 1) for x in (t, F.concat(F.lit(name[:2].upper()), t)))
    got = F.coalesce(F.nullif(own, F.lit("")), F.nullif(short, F.lit("")))
    return F.when(got.isNotNull(), _value(name, got))


def shown(name: str, value: Column) -> Column:
    """A value with its unit and a decimal comma."""
    unit, kind, _ = PARAMS[name]
    return F.trim(F.concat(F.translate(value, ".", ","), F.lit(f" {unit}"))) if kind == "number" else value
