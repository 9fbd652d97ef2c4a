"""Merging candidates of several sources, and matching records. Nothing is chosen by majority or date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions.text import match_score


def consolidate(candidates: DataFrame, by: list[str], source: str, order: str, form: Column, shown: Column) -> DataFrame:
    """One row per group ``by``: ``value`` if all sources read the same comparable form, else null and ``conflict``.

    Within a source the last candidate of a form counts. ``n_sources`` and ``n_forms`` tell what was found and
    ``candidates`` keeps one reading per form, by first appearance.
    """
    c = candidates.withColumns({"_form": form, "_shown": shown})
    c = c.groupBy(*by, source, "_form").agg(F.min(order).alias("_first"), F.max_by("_shown", order).alias("_shown"))
    c = c.groupBy(*by, "_form").agg(F.min("_first").alias("_first"), F.min_by("_shown", "_first").alias("_shown"), F.collect_set(source).alias("_sources"))
    per = c.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_forms"),
        F.size(F.array_distinct(F.flatten(F.collect_list("_sources")))).cast("long").alias("n_sources"),
        F.min("_shown").alias("_only"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_first", "_shown"))), lambda x: x["_shown"]), " / ").alias("candidates"),
    )
    status = F.when(F.col("n_forms") > 1, "conflict").when(F.col("n_sources") > 1, "agreed").otherwise("pending")
    return per.select(*by, F.when(F.col("n_forms") == 1, F.col("_only")).alias("value"), status.alias("status"), "n_sources", "n_forms", "candidates")


def best_rows(lefts: DataFrame, rights: DataFrame, scored: DataFrame, scope: str, left_id: str, right_id: str, ends: list[tuple[str, str]]) -> DataFrame:
    """(left id, right id, score, is_unique) of the best names of each left row.

    ``scored`` has scope, the names of ``ends`` (left and right column each) and a positive score, once for each pair
    of names that fit. Names are many fewer than rows: the best ones are found and their rows counted among names, so
    only pairs of rows that are part of the result are made, at the end, and none of them is exchanged or sorted.
    Repeated rows count once; a left id of several names takes the best of all.
    """
    ls, rs = [x for x, _ in ends], [y for _, y in ends]
    lefts, rights = lefts.select(scope, left_id, *ls).distinct(), rights.select(scope, right_id, *rs).distinct()
    names = Window.partitionBy(scope, *ls)
    best = scored.join(rights.groupBy(scope, *rs).agg(F.count(F.lit(1)).alias("_n")), [scope, *rs])
    best = best.withColumn("_top", F.max("score").over(names)).filter("score = _top").withColumn("_n", F.sum("_n").over(names))
    row = Window.partitionBy(left_id)
    tops = lefts.join(best.select(scope, *ls, "score", "_n").distinct(), [scope, *ls]).withColumn("_top", F.max("score").over(row)).filter("score = _top")
    tops = tops.select(scope, left_id, *ls, "score", (F.sum("_n").over(row) == 1).alias("is_unique"))
    found = best.select(scope, *ls, *rs).join(rights, [scope, *rs]).select(scope, *ls, right_id)
    return tops.join(found, [scope, *ls]).select(left_id, right_id, "score", "is_unique")


def best_matches(left: DataFrame, right: DataFrame, scope: str, left_id: str, right_id: str, left_core: str, right_core: str) -> DataFrame:
    """(left id, right id, score, unique): all right rows of the scope with the best positive score of a left row.

    Equal names meet by an equi-join; names that begin alike meet on the shorter one's own prefixes, so no scope is
    joined with itself whole. Each name meets once, whatever the number of its rows.
    """
    lefts, rights = left.select(scope, left_core).distinct(), right.select(scope, right_core).distinct()
    ends = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.col(c).substr(F.lit(1), i))
    a = lefts.withColumn("_k", F.explode(ends(left_core))).join(rights.withColumn("_k", F.col(right_core)), [scope, "_k"])
    b = lefts.withColumn("_k", F.col(left_core)).join(rights.withColumn("_k", F.explode(ends(right_core))), [scope, "_k"])
    both = a.select(scope, left_core, right_core).unionByName(b.select(scope, left_core, right_core)).distinct()
    scored = both.withColumn("score", match_score(F.col(left_core), F.col(right_core))).filter("score > 0")
    return best_rows(left, right, scored, scope, left_id, right_id, [(left_core, right_core)])


def changed_cells(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, a, b): fields that both sides have and read differently."""
    both = a.select(key, *[F.col(f).alias(f"a_{f}") for f in fields]).join(b.select(key, *[F.col(f).alias(f"b_{f}") for f in fields]), key)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").cast("string").alias("a"), F.col(f"b_{f}").cast("string").alias("b")) for f in fields]))
    return both.select(key, each.alias("x")).select(key, "x.*").filter("a <> b")


def seed(existing: DataFrame, proposed: DataFrame, key: str, fields: list[str], status: str = "status") -> DataFrame:
    """Merge proposals into a table: decided rows keep their fields, proposed rows are refreshed, stale proposals go."""
    e, p = existing.select(key, status, *fields).alias("e"), proposed.select(key, *fields).alias("p")
    j = e.join(p, F.col(f"e.{key}") == F.col(f"p.{key}"), "full_outer")
    decided = F.coalesce(F.col(f"e.{status}") != "proposed", F.lit(False))
    kept = j.filter(decided | F.col(f"p.{key}").isNotNull())
    pick = [F.when(decided, F.col(f"e.{f}")).otherwise(F.col(f"p.{f}")).alias(f) for f in fields]
    return kept.select(F.coalesce(f"e.{key}", f"p.{key}").alias(key), F.coalesce(f"e.{status}", F.lit("proposed")).alias(status), *pick)
