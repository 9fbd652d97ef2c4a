"""Links between records: matching by both ends, links that survive a new file, owners by place, optional filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions.text import match_score
from veritab.operators.merge import best_rows


def best_by_both_ends(left: DataFrame, right: DataFrame, scope: str, left_id: str, right_id: str, ends: tuple[str, str] = ("origin", "destination")) -> DataFrame:
    """(left id, right id, score, is_unique): right rows of the scope that fit both ends, with the best sum of scores.

    ``ends`` are columns of cores on both sides. Equal cores and cores that begin alike meet by equi-joins on the
    beginnings of the first end; the second end is scored on those that met. Each pair of cores meets once, whatever
    the number of its rows.
    """
    a, b = ends
    lefts = left.select(scope, left_id, F.col(a).alias("la"), F.col(b).alias("lb")).filter("la <> '' and lb <> ''")
    rights = right.select(scope, right_id, F.col(a).alias("ra"), F.col(b).alias("rb")).filter("ra <> '' and rb <> ''")
    ls, rs = lefts.select(scope, "la", "lb").distinct(), rights.select(scope, "ra", "rb").distinct()
    starts = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.col(c).substr(F.lit(1), i)))
    one = ls.withColumn("_k", starts("la")).join(rs.withColumn("_k", F.col("ra")), [scope, "_k"])
    two = ls.withColumn("_k", F.col("la")).join(rs.withColumn("_k", starts("ra")), [scope, "_k"])
    met = one.unionByName(two).drop("_k").distinct()
    first, second = match_score(F.col("la"), F.col("ra")), match_score(F.col("lb"), F.col("rb"))
    scored = met.withColumns({"_f": first, "_s": second}).filter("_f > 0 and _s > 0").withColumn("score", F.col("_f") + F.col("_s")).drop("_f", "_s")
    return best_rows(lefts, rights, scored, scope, left_id, right_id, [("la", "ra"), ("lb", "rb")])


def kept_links(new: DataFrame, old: DataFrame, keys: list[str], link: str) -> DataFrame:
    """``new`` with the ``link`` that a person gave to the same keys before, null-safe; of several the least."""
    manual = old.filter(F.col(link).isNotNull()).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(link).alias(link))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = new.join(manual, same, "left")
    return out.select(*new.columns, link, F.when(F.col(link).isNotNull(), "manual").otherwise("unlinked").alias("link_status"))


def nearest_owner(rows: DataFrame, by: str, at: str, owner: Column) -> DataFrame:
    """``rows`` with ``owner_at``: where the last owner before the row stands, else the first one after it."""
    place = F.when(owner, F.col(at))
    w = Window.partitionBy(by).orderBy(at)
    before = F.max(place).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(place).over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("owner_at", F.coalesce(before, after))


def filtered(df: DataFrame, **wanted: list | None) -> DataFrame:
    """Rows whose columns have one of the wanted values; a filter that is None or empty keeps everything."""
    for c, values in wanted.items():
        if values:
            df = df.filter(F.col(c).isin(list(values)))
    return df


def facts_of(facts: DataFrame, keys: list[str] | None = None, prefix: str | None = None, kinds: list[str] | None = None, comparable: bool | None = None) -> DataFrame:
    """Facts by key, by the beginning of the key, by kind of piece and by whether they may be compared; None asks for nothing."""
    out = filtered(facts, key=keys, piece_kind=kinds)
    if prefix is not None:
        out = out.filter(F.col("key").startswith(prefix))
    return out if comparable is None else out.filter(F.col("comparable") == comparable)


def about(paragraphs: DataFrame, subjects: list[str], without: list[str] = ()) -> DataFrame:
    """Paragraphs of block sections whose key holds a subject, and none of ``without``."""
    key = F.col("section_key")
    some = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: key.contains(w))
    out = paragraphs.filter((F.col("section_kind") == "block") & some(subjects))
    return out.filter(~some(without)) if without else out
