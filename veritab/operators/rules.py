"""Validation rules over paragraphs and facts; each gives findings: rule_id, severity, key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions import cables, citations, text

#: Words that name a product, and words that admit another.
NAMED = r"\b(?:da marca|marca|modelo|serie|ref\.?|referencia)\b"
OPEN = r"\b(?:ou\s+)?(?:equivalente|similar|equiparad[oa])\b"


def _found(df: DataFrame, rule: str, severity: Column, *key: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule_id"), severity.alias("severity"), F.concat_ws("|", *[k.cast("string") for k in key]).alias("key"))


def _where() -> list[Column]:
    return [F.col("piece"), F.col("section_key"), F.col("idx")]


def brand_without_equivalent(paragraphs: DataFrame, projects: DataFrame) -> DataFrame:
    """CCP-01: in public procurement, a block paragraph that names a product and does not admit an equivalent."""
    public = projects.filter("public").select("project")
    p = paragraphs.join(public, "project", "left_semi").filter(F.col("piece_kind").isin("CTE", "MDJ") & (F.col("section_kind") == "block"))
    p = p.withColumn("folded", text.fold(F.col("text"))).filter(F.col("folded").rlike(NAMED) & ~F.col("folded").rlike(OPEN))
    return _found(p, "CCP-01", F.lit("warning"), *_where())


def numbers_without_source(paragraphs: DataFrame) -> DataFrame:
    """NUM-01: each number of a generated paragraph that is neither a placeholder nor an allowed form."""
    p = paragraphs.filter(F.col("generated") & F.col("piece_kind").isin("CTE", "MDJ"))
    p = p.select("*", F.posexplode(citations.stray_numbers(F.coalesce("source_text", "text"))).alias("n", "snippet"))
    return _found(p, "NUM-01", F.lit("critical"), *_where(), F.col("n"))


def cited(paragraphs: DataFrame, corpus: list[tuple[str, str]]) -> DataFrame:
    """Paragraphs with one row for each citation: ``citation`` and the ``code`` of the corpus entry that it fits first."""
    p = paragraphs.filter(F.col("piece_kind").isin("CTE", "MDJ")).select("*", F.explode(citations.citations(F.col("text"))).alias("c"))
    p = p.withColumn("citation", F.col("c.text")).drop("c")
    return p.withColumn("code", citations.first_code(F.lower("citation"), corpus))


def unknown_citations(paragraphs: DataFrame, corpus: list[tuple[str, str]]) -> DataFrame:
    """REF-01: citations of texts that no entry of the corpus fits."""
    return _found(cited(paragraphs, corpus).filter("code is null"), "REF-01", F.lit("warning"), F.lit("text"), *_where(), F.lower("citation"))


def unknown_sources(cites: DataFrame, archive: DataFrame, regulations: DataFrame) -> DataFrame:
    """REF-01: sources that generated text names and that neither the archive nor the corpus has.

    ``cites`` (piece, section, anchor, kind, target, version, current_version); other kinds than archive and
    regulation are resolved elsewhere and count as known.
    """
    now = cites.filter("version = current_version")
    known = archive.select(F.lit("archive").alias("kind"), F.col("ref").alias("target")).unionByName(regulations.select(F.lit("regulation").alias("kind"), F.col("code").alias("target")))
    lost = now.filter(F.col("kind").isin("archive", "regulation")).join(known.distinct(), ["kind", "target"], "left_anti")
    return _found(lost, "REF-01", F.lit("critical"), F.col("piece"), F.col("section"), F.col("anchor"), F.col("target"))


def revoked_or_pending(paragraphs: DataFrame, corpus: list[tuple[str, str]], regulations: DataFrame) -> DataFrame:
    """REF-02: each citation of a revoked document, and once per piece the documents that are not yet citable."""
    c = cited(paragraphs, corpus).join(F.broadcast(regulations.select("code", "status", "citable")), "code")  # one row per corpus pattern at most
    revoked = _found(c.filter("status = 'revoked'"), "REF-02", F.lit("critical"), F.lit("revoked"), *_where(), F.col("code")).distinct()
    waiting = c.filter("status <> 'revoked' and not citable").groupBy("piece").agg(F.count_distinct("code").alias("n"))
    return revoked.unionByName(_found(waiting, "REF-02", F.lit("info"), F.lit("pending"), F.col("piece")))


def incomplete_references(paragraphs: DataFrame) -> DataFrame:
    """REF-03: a section or article of the technical rules without its number."""
    p = paragraphs.filter(F.col("piece_kind").isin("CTE", "MDJ")).select("*", F.posexplode(citations.incomplete(F.col("text"))).alias("n", "c"))
    return _found(p, "REF-03", F.lit("warning"), *_where(), F.col("n"))


def pair(a: Column, b: Column) -> list[Column]:
    """An unordered pair as two columns."""
    return [F.least(a, b).alias("low"), F.greatest(a, b).alias("high")]


def equivalences(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """(low, high, status) of unordered pairs: edges (a, b, status), and approved aliases (name, alias), which win."""
    every = edges.select(*pair(F.col("a"), F.col("b")), "status", F.lit(0).alias("o")).unionByName(aliases.select(*pair(F.col("name"), cables.canonical_family(F.col("alias"))), F.lit("approved").alias("status"), F.lit(1).alias("o")))
    return every.groupBy("low", "high").agg(F.max_by("status", "o").alias("status"))


def cable_differences(facts: DataFrame, known: DataFrame) -> DataFrame:
    """COE-06: cable families of the pieces against the calculation table of the project.

    ``facts`` (project, piece_kind, family, earth), ``known`` as from :func:`equivalences`. A rigid family where the
    table has the flexible one of its base, or the reverse, is critical; a family of which the table has the kind
    but no approved equivalent is a warning. Earth conductors and families of no kind of the table are left out.
    """
    reference = facts.filter("piece_kind = 'CALC'").select("project", F.col("family").alias("r")).distinct()
    group = F.when(F.col("piece_kind").isin("MDJ", "CTE"), "escritas").when(F.col("piece_kind").isin("MQT", "LPU"), "quantidades")
    found = facts.filter(~F.col("earth")).withColumn("grp", group).filter("grp is not null").select("project", "grp", "family").distinct()
    found = found.join(reference, (found["project"] == reference["project"]) & (found["family"] == reference["r"]), "left_anti")
    j = found.join(reference, "project").withColumns({"low": F.least("family", "r"), "high": F.greatest("family", "r")}).join(known, ["low", "high"], "left")
    f, r = F.col("family"), F.col("r")
    opposite = (cables.base(f) == cables.base(r)) & F.coalesce(cables.flexible(f) != cables.flexible(r), F.lit(False))
    g = j.groupBy("project", "grp", "family").agg(
        F.max(F.coalesce(F.col("status") == "approved", F.lit(False))).alias("approved"),
        F.min(F.when(opposite, r)).alias("opposite"),
        F.min(F.when(F.col("status") == "proposed", r)).alias("proposed"),
        F.min(F.when(cables.kind(f) == cables.kind(r), r)).alias("alike"),
    )
    g = g.filter("not approved and (opposite is not null or alike is not null)")
    severity = F.when(F.col("opposite").isNotNull(), "critical").otherwise("warning")
    return _found(g, "COE-06", severity, F.col("project"), F.col("grp"), f, F.coalesce("opposite", "proposed", "alike"))
