"""What archives teach: which terms go with which kinds, and which equipment lines name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions import text
from veritab.functions.spans import let

QUOTED = r"[´'‘’\"“”]\s*(.+?)\s*[´'‘’\"“”]"
#: Where a model ends, a reference, and words that admit another product.
STOP = r"(?=\s*(?:,|;|:|\s+da\s|\s+de\s|\s+do\s|\s+ou\b|\s+com\b|\s+na cor|\s+equipad|$))"
REFERENCE = r"(?i)\bref(?:er[eê]ncia|\.ª|ª|\.)?(?![a-zà-ÿ])\s*[:.]?\s*([+]?[A-Z0-9][\w.\-/()+]*(?:\s+[A-Z0-9][\w.\-/()+]*)*?)(?=\s*(?:,|;|:|\(|\s+ou\b|\s+da\b|\s+centro|\s+com\b|\s+e\s+respetivos|$))"
EQUIVALENT = r"(?i)\bou\s+(?:de qualidade e caracter[ií]sticas\s+)?equivalentes?\b"
AFTER = r"(?i),|;|:|\s+ou\b|\s+da\b|\s+de\b|\s+e\s|\s+na cor|\s+para\b|\s+com\b|\s+inclinad|\s+ref\b|\s+ref\.|\s+[-–—]\s"


def _said(x: Column) -> Column:
    return F.nullif(F.regexp_replace(F.trim(x), r"^[\s,.;:–—-]+|[\s,.;:–—-]+$", ""), F.lit(""))


def reference_line(line: Column, low: Column, brands: list[str]) -> Column:
    """(brand, model, reference, or_equivalent) of a line that names a brand and a model or a reference; else null.

    ``low`` is the folded line. The brand that stands first counts. The model is what follows "modelo", else "série", else
    (without a reference) "do tipo", else the brand itself; a reference is a code with a digit.
    """
    places = F.array(*[F.struct(F.nullif(F.regexp_instr(low, F.lit(rf"(?<![\w-])\Q{text.folded_value(b)}\E(?![\w-])")), F.lit(0)).alias("at"), F.lit(b).alias("brand")) for b in brands])
    got = lambda p, g=1: _said(F.regexp_extract(line, p, g))
    model = rf"(?i)\bmodelo(?:\s+de\s+refer[eê]ncia(?:\s+de\s+projeto)?)?\s*:?\s*(?:{QUOTED}|(.+?){STOP})"

    def of(found: Column) -> Column:
        brand, code = found["brand"], found["code"]
        starts = lambda x: F.lower(x).startswith(F.concat(F.lower(brand), F.lit(" ")))
        bare = lambda x: _said(F.when(starts(x), x.substr(F.length(brand) + 1, F.length(x))).otherwise(x))
        kind = F.when(code.isNull(), bare(got(rf"(?i)\bdo tipo\s+(.+?){STOP}")))
        rest = line.substr(F.instr(F.lower(line), F.lower(brand)) + F.length(brand), F.length(line))
        rest = F.regexp_replace(F.regexp_replace(rest, r"^\s*(?:S\.?A\.?|Lda\.?)\s*", ""), r"^[\s\-–—]+", "")
        cut = _said(F.split(rest, AFTER, 2)[0])
        follows = F.when(~rest.rlike("(?i)^ref") & cut.rlike(r"^[\p{Lu}\d+]"), cut)
        said = F.coalesce(bare(F.coalesce(got(model, 1), got(model, 2))), got(rf"(?i)\bs[eé]rie\s+(.+?){STOP}"), F.when(F.lower(kind) != F.lower(brand), kind), follows)
        return let(said, lambda m: F.when(m.isNotNull() | code.isNotNull(), F.struct(brand.alias("brand"), m.alias("model"), code.alias("reference"), line.rlike(EQUIVALENT).alias("or_equivalent"))))

    code = got(REFERENCE)
    first = F.array_min(F.filter(places, lambda p: p["at"].isNotNull()))["brand"]
    return let(first, lambda b: F.when(b.isNotNull(), let(F.struct(b.alias("brand"), F.when(code.rlike(r"\d"), code).alias("code")), of)))


def equipment(lines: DataFrame, brands: list[str]) -> DataFrame:
    """(project, idx, owner, brand, model, reference, or_equivalent) of lines (project, idx, title, text).

    A line belongs to the title above it: lines that have a ``title`` are chapters, and the last one before a line owns it.
    """
    w = Window.partitionBy("project").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    owned = lines.withColumns({"owner": F.last("title", ignorenulls=True).over(w), "low": text.fold(F.col("text"))}).withColumn("f", reference_line(F.col("text"), F.col("low"), brands))
    return owned.filter("f is not null").select("project", "idx", "owner", "f.*")


def _told(said: DataFrame, every: DataFrame) -> DataFrame:
    """(kind, term) once for each document: terms are dealt by document once, for being told apart and for meeting their kind."""
    one = said.filter("term is not null").select("doc", "term").repartition("doc").distinct()
    return one.join(every, "doc").select("kind", "term")


def associations(said: DataFrame, kinds: DataFrame, least: int) -> DataFrame:
    """(kind, term, n, of_term, of_kind, lift) of terms that ``least`` documents of a kind hold.

    ``said`` (doc, term) in any number, ``kinds`` (doc, kind) one row a document. ``n`` documents of the kind hold the
    term, ``of_term`` documents of any kind do, the kind has ``of_kind`` documents; ``lift`` is how much more often the kind
    holds it than all do, in millionths, rounded down. Null terms and kinds are left out; a document counts once.
    """
    every = kinds.filter("kind is not null")
    size = every.groupBy("kind").agg(F.count(F.lit(1)).alias("of_kind"))
    total = size.agg(F.sum("of_kind").alias("of_all"))  # one row
    one = _told(said, every).groupBy("kind", "term").agg(F.count(F.lit(1)).alias("n"))
    terms = one.groupBy("term").agg(F.sum("n").alias("of_term"))
    j = one.filter(F.col("n") >= least).join(terms, "term").join(size, "kind").join(F.broadcast(total))
    return j.select("kind", "term", "n", "of_term", "of_kind", F.expr("(cast(1000000 as decimal(7,0)) * n * of_all) div (cast(of_term as decimal(19,0)) * of_kind)").alias("lift"))


def never_said(said: DataFrame, kinds: DataFrame, least: int) -> DataFrame:
    """(kind, term, elsewhere): terms that ``least`` documents of every other kind hold and none of this one. Kinds are few."""
    every = kinds.filter("kind is not null")
    one = _told(said, every).groupBy("term", "kind").agg(F.count(F.lit(1)).alias("n"))
    g = one.groupBy("term").agg(F.collect_set("kind").alias("kinds"), F.min("n").alias("least"), F.sum("n").alias("elsewhere")).filter(F.col("least") >= least)
    names = every.agg(F.collect_set("kind").alias("names"))  # one row; kinds are few
    lacks = g.join(F.broadcast(names)).withColumn("lacks", F.array_except("names", "kinds")).filter(F.size("lacks") == 1)
    return lacks.select(F.col("lacks")[0].alias("kind"), "term", "elsewhere")
