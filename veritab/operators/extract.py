"""Typed facts of paragraphs: matches as rows with what stands before them, behind a gate of sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions import cables, spans, text, words
from veritab.functions.numbers import number_text, rule_number

#: Sections that speak of a subject, words before a power that is no supply or an existing one, and how far they are looked for.
BOARDS, CHARGERS, PANELS, LIGHTING, NOT_LIGHTING = "quadro|distribuicao", "veiculos_eletricos", "fotovolt", "iluminacao", "comando"
NOT_SUPPLY, EXISTING = r"\b(?:ups|gerador|grupo|transformador|inversor|bateria)s?\b\W*$", r"\b(?:atualmente|actualmente|existente|atual|actual)\b"
CONTEXT, CLOSE = 70, 30
KVA, KWP = r"(?<![\w,.])(\d+(?:[.,]\d+)?)\s*[kK][vV][aA]\b", r"(?<![\w,.])(\d+(?:[.,]\d+)?)\s*[kK][wW][pP]\b"
BOARD = r"(?U)\(?\bQ\.\s?(?:E\.?\s?G|P|[A-Z])[\w.\- ]*?\)?(?=[\s,;:)]|$)"
CODE = r"(?:L\d+(?:\.\d+)?|SNC)"
LUMINAIRES = rf"(?i)^\s*(?:tipo\s+)?({CODE}(?:\s*(?:e|,|/)\s*{CODE})*)\s*[-–—:]"
#: Labels of covers and signatures.
COVER = (("id.requerente.nome", r"requerente"), ("id.local.rua", r"localiza[cçCÇ][aãAÃ]o"), ("id.obra.designacao", r"obra"))
POSTAL = r"^\s*(\d{4}\s?[-–]\s?\d{3})\s*,?\s*(.*?)\s*$"
SIGNED = (("tec.cc", r"(?i)^\s*C\.?\s?C\.?\s*(?:n\.?º)?\s*:?\s*(.+?)\s*$"), ("tec.oet", r"(?i)^\s*Membro\s+(?:da\s+)?OET\s*:?\s*(?:n\.?º)?\s*(.+?)\s*$"), ("tec.codigo_verificacao", r"(?i)verifica[cç][aã]o[^:]*:\s*(.+?)\s*$"),
          ("tec.email", r"(?i)^\s*(?:email|e-mail)\s*:?\s*(\S+@\S+)\s*$"), ("tec.telefone", r"(?i)^\s*(?:tel\.?|telefone|telem[oó]vel)\s*:?\s*([+\d][\d\s]{7,})\s*$"))
LEAST = 4


def text_facts(paragraphs: DataFrame) -> DataFrame:
    """(project, piece, key, value, idx) of paragraphs (project, piece, section_kind, section, idx, text).

    Powers are facts each, unless the words just before say that they belong to a device; words in the CONTEXT before
    tell an existing power from the one to supply. Of counted things the first count of a piece stands; boards and
    types of luminaires are one list a piece, in natural order. Only blocks of a section that speaks of the subject
    are read. Null texts have no facts. The paragraphs are read twice: for facts that stand alone, and for those that
    a piece has one of.
    """
    p = paragraphs.filter((F.col("section_kind") == "block") & F.col("text").isNotNull())
    return _lone_facts(p).unionByName(_piece_facts(p))


def _stacked(p: DataFrame, *each: Column) -> DataFrame:
    """A row for each item of arrays of (key, said, before)."""
    return p.select("project", "piece", "idx", F.explode(F.concat(*each)).alias("x")).select("project", "piece", "idx", "x.*")


def _item(key: str, said: Column, before: Column | None = None) -> Column:
    return F.struct(F.lit(key).alias("key"), said.alias("said"), (F.lit(None).cast("string") if before is None else before).alias("before"))


def _lone_facts(p: DataFrame) -> DataFrame:
    """Powers with what stands before them, and cables."""
    t = F.col("text")
    before = lambda s: t.substr(F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT)))
    powers = F.transform(spans.found(t, KVA, 1), lambda s: _item("", s["text"], before(s)))
    rows = _stacked(p, powers, F.transform(cables.designations(t), lambda d: _item("cabo", d["family"])))
    rows = rows.withColumn("before", text.fold(F.col("before")))
    number, cable = number_text(rule_number(F.col("said"))), F.col("key") == "cabo"
    supply = F.when(F.col("before").rlike(EXISTING), "ele.potencia_existente_kva").otherwise("ele.potencia_alimentar_kva")
    one = F.array(F.struct(F.when(cable, F.col("key")).otherwise(supply).alias("key"), F.when(cable, F.col("said")).otherwise(number).alias("value")))
    one = F.when(cable | (~F.expr(f"right(before, {CLOSE})").rlike(NOT_SUPPLY) & number.isNotNull()), one)  # a filter would fold a second time
    return rows.select("project", "piece", F.explode(one).alias("x"), "idx").select("project", "piece", "x.key", "x.value", "idx")


#: Counted things: key -> (sections, noun, container).
COUNTED = {"qty.quadros": (BOARDS, r"quadros?\s+eletrico", "xx"), "qty.ve_carregadores": (CHARGERS, "carregador(?:es)?", r"(?:pedestal|pedestais|postos?)"), "qty.fv_modulos": (PANELS, r"modulos?(?:\s+fotovoltaico)?", "xx")}


def _piece_facts(p: DataFrame) -> DataFrame:
    """The first count of each thing, the first peak power, and the lists of boards and of types of luminaires."""
    t, key, said = F.col("text"), F.col("key"), F.col("said")
    inside = lambda pattern, items: F.when(F.col("section").rlike(pattern), items).otherwise(F.array().cast("array<struct<key:string,said:string,before:string>>"))
    every = lambda k, pattern: F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda x: _item(k, x))
    peak = F.when(t.rlike(KWP), F.array(_item("fv.potencia_kwp", F.regexp_extract(t, KWP, 1)))).otherwise(F.array().cast("array<struct<key:string,said:string,before:string>>"))
    lit = F.transform(text.luminaire_codes(F.regexp_extract(t, LUMINAIRES, 1)), lambda c: _item("types.luminarias", text.luminaire_type(c)))
    rows = _stacked(p, *[inside(s, F.array(_item(k, t))) for k, (s, _, _) in COUNTED.items()], inside(PANELS, peak), inside(BOARDS, every("names.quadros", BOARD)), F.when(F.col("section").rlike(NOT_LIGHTING), inside("(?!)", lit)).otherwise(inside(LIGHTING, lit)))
    board, w = key == "names.quadros", F.col("w")
    rows = rows.withColumn("w", text.fold(F.when(board, text.unprefixed(said)).when(key.isin(*COUNTED), said)))
    value = F.when(board, F.nullif(text.core_of(w), F.lit(""))).when(key == "fv.potencia_kwp", number_text(rule_number(said))).when(key == "types.luminarias", said)
    for k, (_, noun, container) in COUNTED.items():
        value = value.when(key == k, words.quantity_of(w, noun, container).cast("string"))
    listed = board | (key == "types.luminarias")
    rows = rows.select("project", "piece", "key", "idx", value.alias("v"))
    first = F.min(F.when(F.col("v").isNotNull(), F.struct("idx", "v")))  # a filter before would work the values out a second time
    g = rows.groupBy("project", "piece", "key").agg(first.alias("f"), F.collect_set(F.when(listed, F.col("v"))).alias("l")).filter("f is not null")
    natural = lambda c: F.struct(F.regexp_replace(c, r"\d+$", "").alias("a"), F.coalesce(F.regexp_extract(c, r"(\d+)$", 1).try_cast("int"), F.lit(0)).alias("n"), c.alias("t"))
    types = F.transform(F.array_sort(F.transform("l", natural)), lambda x: x["t"])
    named = F.when(board, F.array_join(F.array_sort("l"), ", ")).when(key == "types.luminarias", F.array_join(types, ", ")).otherwise(F.col("f.v"))
    return g.select("project", "piece", "key", named.alias("value"), F.col("f.idx").alias("idx"))


def identity_facts(paragraphs: DataFrame, postal: str = POSTAL) -> DataFrame:
    """(project, piece, key, value, idx) of covers and signatures by their labels.

    The line after a location gives postal code and place, the two groups of ``postal``. Values are tidied and have LEAST characters at least, but
    for numbers of cards and members. A signature's line of place and date, or of name and title, is read as such.
    """
    lines = paragraphs.filter(F.col("section_kind").isin("cover", "signature") & F.col("text").isNotNull())
    key = F.coalesce(*[F.when((F.col("section_kind") == "cover") & F.col("text").rlike(rf"(?iu)^\s*(?:{p})\s*:?\s*\S"), k) for k, p in COVER])
    lines = lines.withColumn("label", key).withColumn("prior", F.lag("label").over(Window.partitionBy("project", "piece", "section_kind").orderBy("idx", "text")))
    got = lambda pattern, group=1: F.regexp_extract("text", pattern, group)
    pair = lambda k, v: F.struct(k.alias("key") if isinstance(k, Column) else F.lit(k).alias("key"), F.regexp_replace(F.trim(F.regexp_replace(v, r"\s+", " ")), r"^[ ,;:]+|[ ,;:]+$", "").alias("value"))
    cover = F.when(F.col("label").isNotNull(), F.array(pair(F.col("label"), F.coalesce(*[F.when(F.col("label") == k, got(rf"(?iu)^\s*(?:{p})\s*:?\s*(.+?)\s*$")) for k, p in COVER]))))
    cover = cover.when((F.col("prior") == "id.local.rua") & F.col("text").rlike(postal), F.array(pair("id.local.cp", got(postal)), pair("id.local.concelho", got(postal, 2))))
    dated, titled = r"^\s*([^,\d]+?),\s*(\w+\s+de\s+\d{4})\s*\.?\s*$", r"(?i)^\s*([^,\d]+?),\s*(eng\w*\.?\s.*?)\s*$"
    signed = F.when(F.col("text").rlike(dated), F.array(pair("doc.local", got(dated)), pair("doc.data", got(dated, 2)))).when(F.col("text").rlike(titled), F.array(pair("tec.nome", got(titled)), pair("tec.titulo", got(titled, 2))))
    for k, p in SIGNED:
        signed = signed.when(F.col("text").rlike(p), F.array(pair(k, got(p))))
    each = lines.select("project", "piece", "idx", F.explode(F.when(F.col("section_kind") == "cover", cover).otherwise(signed)).alias("x"))
    return each.select("project", "piece", "x.key", "x.value", "idx").filter((F.length("value") >= LEAST) | (F.col("key").isin("tec.cc", "tec.oet") & (F.col("value") != "")))
