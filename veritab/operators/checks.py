"""Checks over facts and paragraphs that more than one rule uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.operators.windows import first_per


def against_reference(facts: DataFrame, piece: str, reference: list[str], order: str = "ord") -> DataFrame:
    """(project, key, piece, value, reference, reference_piece) of pieces that differ from the reference.

    Of each piece and key the first fact counts; the reference is the first of ``reference`` that has the key.
    """
    one = first_per(facts, ["project", piece, "key"], F.col(order))
    rank = F.array_position(F.array(*[F.lit(r) for r in reference]), F.col(piece))
    ref = one.filter(rank > 0).groupBy("project", "key").agg(F.min_by(F.struct(F.col("value_text").alias("v"), F.col(piece).alias("p")), rank).alias("r"))
    j = one.join(ref, ["project", "key"]).filter((F.col(piece) != F.col("r.p")) & (F.col("value_text") != F.col("r.v")))
    return j.select("project", "key", piece, F.col("value_text").alias("value"), F.col("r.v").alias("reference"), F.col("r.p").alias("reference_piece"))


def likely_reading(observations: DataFrame, by: list[str], piece: str, value: str, date: str) -> DataFrame:
    """What a divergence probably is: one odd piece (newer: the others are suspect, else it is), or several readings."""
    v = observations.groupBy(*by, value).agg(F.count_distinct(piece).alias("_n"), F.max(date).alias("_d"), F.min(piece).alias("_p"))
    g = v.groupBy(*by).agg(F.count(F.lit(1)).alias("values"), F.sort_array(F.collect_list(F.struct("_n", "_d", "_p"))).alias("s")).filter("values > 1")
    odd, rest = F.col("s")[0], F.array_max(F.transform(F.slice("s", 2, F.size("s")), lambda x: x["_d"]))
    single = (F.col("values") == 2) & (odd["_n"] == 1) & (F.col("s")[1]["_n"] > 1)
    reading = F.when(~single, "several").when(odd["_d"] > rest, "others_outdated").otherwise("piece_wrong")
    return g.select(*by, "values", reading.alias("reading"), F.when(single, odd["_p"]).alias("piece"))


#: Terms up to which each paragraph is searched for them one by one, which is cheaper than its runs of words are.
FEW = 64


def terms_in(paragraphs: DataFrame, words: Column, terms: DataFrame, term: str = "term", few: int = FEW) -> DataFrame:
    """(term, paragraph columns): whole-word terms of one to three words found in word texts.

    Up to ``few`` terms go to every task; more meet the runs of words of the paragraphs by an equi-join.
    """
    terms = terms.filter(F.col(term).isNotNull())
    known = terms.groupBy(F.size(F.split(term, " ")).alias("n")).count().collect()  # one to three rows
    if sum(r["count"] for r in known) <= few:
        padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
        met = paragraphs.withColumn("_padded", padded(words)).join(F.broadcast(terms), F.col("_padded").contains(padded(F.col(term))))
        return met.select(term, *paragraphs.columns, *[c for c in terms.columns if c != term])
    lengths = [r["n"] for r in known]

    def runs_of(w: Column) -> Column:
        each = [F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), _run(w, n))).otherwise(F.array().cast("array<string>")) for n in lengths]
        return F.array_distinct(F.concat(*each))

    runs = F.transform(F.array(F.split(words, " ")), runs_of)[0]  # a lambda variable, so the words are split once
    return paragraphs.withColumn(term, F.explode(runs)).join(terms, term)


def _run(w: Column, n: int):
    return lambda i: F.array_join(F.slice(w, i, n), " ")


def unique_owner(variants: DataFrame, variant: str, owner: str) -> DataFrame:
    """Variants that one owner alone has."""
    return variants.groupBy(variant).agg(F.count_distinct(owner).alias("_n"), F.min(owner).alias(owner)).filter("_n = 1").drop("_n")


def between_labels(labels: DataFrame, values: DataFrame, by: str, at: str) -> DataFrame:
    """Each value with the label that stands last at or before it: one union and one window, no range join."""
    both = labels.select(by, at, "label", F.lit(0).alias("_s"), F.lit(None).cast(values.schema["value"].dataType).alias("value")).unionByName(values.select(by, at, F.lit(None).cast("string").alias("label"), F.lit(1).alias("_s"), "value"))
    w = Window.partitionBy(by).orderBy(at, "_s").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("label", F.last("label", ignorenulls=True).over(w)).filter("_s = 1").select(by, at, "label", "value")


def remapped(parents: DataFrame, children: DataFrame, parent_id: str, child_parent: str, seed: str) -> tuple[DataFrame, DataFrame]:
    """A copy of a table and of its children under new ids, which follow from the old ones and ``seed``."""
    new = lambda c: F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.col(c).cast("string")), 256), 1, 32)
    return parents.withColumn(parent_id, new(parent_id)), children.withColumn(child_parent, new(child_parent))
