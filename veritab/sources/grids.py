"""What a workbook is, and its tables: relational operators over cells (path, sheet_no, row, col, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.functions.numbers import ingest_number
from veritab.functions.text import fold
from veritab.functions.words import cable_section
from veritab.operators.windows import first_per

#: Rows that may hold a header, rows that may hold the title, and the cell of a form's version (row, column).
HEADER_ROWS, TITLE_ROWS, VERSION_CELL = 40, 12, (45, 18)
#: Columns of the calculation table, by the first pattern that its folded header fits.
COLUMNS = (
    ("origin", r"^origem"), ("destination", r"^destino"),
    ("vd_section_pct", r"(q\.?d\.?t|queda|\bdu\b).*(troco|parcial)"), ("vd_upstream_pct", r"(q\.?d\.?t|queda|\bdu\b).*(montante|anterior)"), ("vd_total_pct", r"(q\.?d\.?t|queda|\bdu\b).*(total|acumulad)"),
    ("iz145_a", r"1[.,]45"), ("idn_ma", r"^i\s?[δ∆d]\s?n\b|diferencial"), ("ib_a", r"^ib\b"), ("in_a", r"^in\b"), ("iz_a", r"^iz\b"), ("i2_a", r"^i2\b"),
    ("kva", r"^total instalado|^pot|^kva"), ("voltage_v", r"^tensao|^u \(v\)"), ("protection_type", r"^(tipo de )?prote[cç]|fusivel|disjuntor"), ("breaking_capacity_ka", r"^pdc|poder de corte"),
    ("length_m", r"^comprim|^l \(m\)"), ("pole_type", r"^polo|^n\.?o? de polos|monopolar|multipolar"), ("installation", r"^instala|^montagem|^tipo de instala|enterrad|esteira|embebid"),
    ("phases", r"^fases|^n\.?o? (de )?fases|monofasic|trifasic"), ("insulation", r"^isolament"), ("conductor", r"^(condutor|material)( \(.*\))?$|cobre|alumin"),
    ("ref_method", r"^metodo|^met\.? ref"), ("rtiebt_table", r"rtiebt"), ("cable_raw", r"^cabo|^canaliza|designa"),
)


def unique_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, hash) of the files under a folder, one for each content: the first path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return first_per(files.select("path", F.sha2("content", 256).alias("hash")), ["hash"], F.col("path"))


def detect(cells: DataFrame) -> DataFrame:
    """(path, kind, version): what each workbook is, by the first sheet that tells; ``other`` if none does.

    A version cell makes it a form; a row with ORIGEM and DESTINO a calculation table; a row with DESIGNAÇÃO and
    QUANT a list of quantities, which is a price list if the title says so.
    """
    c = cells.filter((F.col("row") <= HEADER_ROWS) | ((F.col("row") == VERSION_CELL[0]) & (F.col("col") == VERSION_CELL[1]))).withColumn("w", fold(F.col("value")))
    form = F.max(F.when((F.col("row") == VERSION_CELL[0]) & (F.col("col") == VERSION_CELL[1]) & F.trim("value").startswith("FE_v"), F.trim("value")))
    has = lambda x: F.max(F.col("w") == x)
    rows = c.groupBy("path", "sheet_no", "row").agg(
        form.alias("form"), (has("origem") & has("destino")).alias("calc"), (F.max(F.col("w").contains("designacao")) & F.max(F.col("w").startswith("quant"))).alias("list"),
        ((F.col("row") <= TITLE_ROWS) & F.max(F.col("w").contains("lista de precos"))).alias("prices"))
    s = rows.groupBy("path", "sheet_no").agg(F.max("form").alias("version"), F.max("calc").alias("calc"), F.max("list").alias("list"), F.max("prices").alias("prices"))
    kind = F.when(F.col("version").isNotNull(), "ficha_eletrotecnica").when(F.col("calc"), "calc_summary").when(F.col("list") & F.col("prices"), "lpu").when(F.col("list"), "mqt")
    told = s.withColumn("kind", kind).groupBy("path").agg(F.min_by(F.struct("kind", "version"), F.when(kind.isNotNull(), F.col("sheet_no"))).alias("k"))
    return told.select("path", F.coalesce("k.kind", F.lit("other")).alias("kind"), F.col("k.version").alias("version"))


def field_of(folded: Column) -> Column:
    """The field of the first pattern of COLUMNS that a header fits; null if none."""
    return F.coalesce(*[F.when(folded.rlike(p), F.lit(f)) for f, p in COLUMNS])


#: Fields that hold numbers, and columns that are known but not kept.
NUMERIC = ("kva", "voltage_v", "ib_a", "in_a", "idn_ma", "iz_a", "i2_a", "iz145_a", "length_m", "vd_section_pct", "vd_upstream_pct", "vd_total_pct", "breaking_capacity_ka")
UNUSED = r"^norma|^socorro|^seguranca|quadros|^tipo c$|^imped|corte geral"
FIELDS = [f for f, _ in COLUMNS]


def typed(field: str, raw: Column) -> Column:
    """A cell's text as its field has it: numbers, the codes of enumerations (null if it is none of them), or trimmed text."""
    w = fold(raw)
    begins = lambda *heads: w.rlike("^(?:" + "|".join(heads) + ")")
    if field in NUMERIC:
        return ingest_number(raw)
    if field == "protection_type":
        return F.when(begins("d"), "D").when(begins("f"), "F")
    if field == "pole_type":
        return F.when(begins("mon", "uni", "1"), "MON").when(begins("mul", "tri", "tetra", "bi", "3", "4"), "MUL")
    if field == "installation":
        code = F.upper(F.substring(w, 1, 3))
        return F.when(code.isin("TUB", "EST", "ENT"), code).when(begins("ar"), "AR")
    if field == "phases":
        return F.when(begins("tri", "3"), 3).when(begins("mon", "1"), 1)
    if field == "conductor":
        return F.when(begins("cu"), "Cu").when(begins("al"), "Al")
    return F.trim(raw)


def _headed(cells: DataFrame) -> DataFrame:
    """(path, sheet_no, row, col, value, w, number, top, two): cells of the first sheet of each workbook that has a header.

    The header is the first row with ORIGEM and DESTINO (``top``); a next row of two texts or more without a number is
    its second line (``two`` = 1). Folded cells are dealt by workbook once (Python evaluation would lose the dealing), and all
    that follows is told inside it by windows.
    """
    c = cells.select("path", "sheet_no", "row", "col", "value").filter(F.trim("value") != "")
    c = c.withColumns({"w": fold(F.col("value")), "number": ingest_number(F.col("value")).isNotNull()})
    c = c.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    row, book = Window.partitionBy("path", "sheet_no", "row"), Window.partitionBy("path")
    begins = lambda x: F.max(F.col("w").startswith(x)).over(row)
    c = c.withColumns({"_head": begins("origem") & begins("destino"), "_n": F.count(F.lit(1)).over(row), "_numbers": F.max("number").over(row)})
    c = c.withColumn("_at", F.min(F.when(F.col("_head") & (F.col("row") <= HEADER_ROWS), F.struct("sheet_no", "row"))).over(book)).filter(F.col("sheet_no") == F.col("_at.sheet_no"))
    c = c.withColumn("top", F.col("_at.row"))
    second = (F.col("row") == F.col("top") + 1) & (F.col("_n") >= 2) & ~F.col("_numbers")
    return c.withColumn("two", F.max(F.when(second, 1).otherwise(0)).over(book)).drop("_head", "_n", "_numbers", "_at")


#: Whether a cell of :func:`_headed` is part of the header.
_NAMING = "row BETWEEN top AND top + two"


def calc_rows(cells: DataFrame) -> DataFrame:
    """(path, sheet_no, row, section, a column for each field, section_mm2): rows of the calculation table, typed.

    Of each workbook the first sheet with a header is read, see :func:`_headed`; a second line names the columns where
    it has text, and of columns with one field the first counts. A row with one text and no destination is a section
    line for the rows below it; rows without origin and destination are left out. Numbers and codes that a cell does
    not hold are null. ``section_mm2`` is read from the cable's name. Repeated cells of one place: the greatest text
    counts. No header: no rows.
    """
    c = _headed(cells)
    named = F.when(F.expr(_NAMING), F.struct("row", "w", F.col("value").alias("text"), field_of(F.col("w")).alias("field")))
    c = c.withColumn("field", F.max(named).over(Window.partitionBy("path", "col"))["field"])
    first = F.min(F.when(F.col("field").isNotNull(), F.col("col"))).over(Window.partitionBy("path", "field"))
    data = c.withColumn("_first", first).filter("row > top + two").withColumn("field", F.when(F.col("col") == F.col("_first"), F.col("field")))
    of = [F.max(F.when(F.col("field") == f, F.trim("value"))).alias(f) for f in FIELDS]
    r = data.groupBy("path", "sheet_no", "row").agg(*of, F.size(F.collect_set("col")).alias("n"), F.max("number").alias("numbers"), F.max(F.trim("value")).alias("only"))
    line = (F.col("n") == 1) & ~F.col("numbers") & F.col("destination").isNull()
    w = Window.partitionBy("path").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("section", F.last(F.when(line, F.col("only")), ignorenulls=True).over(w))
    r = r.filter(~line & (F.col("destination").isNotNull() | F.col("origin").isNotNull()))
    return r.select("path", "sheet_no", "row", "section", *[typed(f, F.col(f)).alias(f) for f in FIELDS], cable_section(F.col("cable_raw")).alias("section_mm2"))


def calc_warnings(cells: DataFrame) -> DataFrame:
    """(path, warning): columns of the header that no pattern knows, or whose field an earlier column has."""
    named = _headed(cells).filter(_NAMING).groupBy("path", "col").agg(F.max(F.struct("row", "w", F.col("value").alias("text"))).alias("h"))
    named = named.select("path", "col", "h.w", "h.text", field_of(F.col("h.w")).alias("field"))
    named = named.withColumn("nth", F.row_number().over(Window.partitionBy("path", "field").orderBy("col")))
    odd = F.when(F.col("field").isNull(), ~F.col("w").rlike(UNUSED)).otherwise(F.col("nth") > 1)
    label = F.substring(F.regexp_replace(F.trim("text"), r"\s+", " "), 1, 60)
    return named.filter(odd).select("path", F.concat(F.lit("Coluna não reconhecida: «"), label, F.lit("».")).alias("warning"))


def calc_values(rows: DataFrame) -> DataFrame:
    """(path, key, value): what a project takes from the table: power and supply of the first row, the boards and cables.

    A board is an origin or destination that is named as one; lists are in order of appearance. The rows are read once
    and a workbook is one group.
    """
    g = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("row", "kva", "phases", "origin", "destination", "cable_raw"))).alias("r"))
    first = F.col("r")[0]
    phases = F.when(first["phases"] == 3, "Trif").when(first["phases"] == 1, "Mono")
    boards = F.filter(F.flatten(F.transform("r", lambda x: F.array(x["origin"], x["destination"]))), lambda v: v.rlike(r"(?i)^q\b|^q\.|^quadro"))
    cables = F.filter(F.transform("r", lambda x: x["cable_raw"]), lambda v: v.isNotNull())
    listed = lambda x: F.when(F.size(x) > 0, F.array_join(F.array_distinct(x), "; "))
    told = {"ele.potencia_alimentar_kva": first["kva"].cast("string"), "ele.entrada": phases, "ele.quadros": listed(boards), "ele.cabos": listed(cables)}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in told.items()]))
    return g.select("path", each.alias("x")).select("path", "x.*").filter("value is not null")


def scaled(values: DataFrame, scales: DataFrame) -> DataFrame:
    """``values`` (key, value) as numbers times the scale of their key, where ``scales`` (key, scale) has one.

    The map is a small table and goes to every task; values of a few keys are not dealt by them.
    """
    s = F.broadcast(scales.select(F.col("key").alias("_k"), "scale"))
    j = values.join(s, F.col("key") == F.col("_k"), "left")
    return j.withColumn("number", ingest_number(F.col("value")) * F.coalesce("scale", F.lit(1.0))).drop("_k", "scale")
