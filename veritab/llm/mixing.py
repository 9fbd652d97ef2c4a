"""Capped water-filling: mix sources to target weights with whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.llm.common import WORD, saved, small, table

#: Slices of a source's seeded order; only the slice that holds the cut is looked at row by row.
SLICES = 4096


def water_fill(sources: DataFrame, cap: int) -> DataFrame:
    """(source, source_size, weight) -> ``num``, ``den``, ``target`` with target = min(cap * size, weight * level).

    The level follows in one pass from the sources in order of size / weight: the sources below the level stop at
    their cap, the others share by weight what those leave. ``target`` is num / den, so that rounding is exact.
    """
    w = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = sources.withColumn("left_words", F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(upto), F.lit(0)))
    s = s.withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    s = s.withColumn("capped", cap * F.col("source_size") * F.col("left_weight") <= F.col("left_words") * F.col("weight"))
    s = s.withColumn("free", F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight"), F.col("left_words"), F.col("left_weight")))).over(every))
    s = s.withColumn("num", F.when(F.col("capped"), cap * F.col("source_size")).otherwise(F.col("weight") * F.col("free.left_words")))
    s = s.withColumn("den", F.when(F.col("capped"), F.lit(1).cast("long")).otherwise(F.col("free.left_weight")))
    return s.select("source", "source_size", "num", "den", (F.col("num").cast("double") / F.col("den").cast("double")).alias("target"))


def mix(rows: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 7) -> DataFrame:
    """One row per row of ``rows``: id, ``size`` (words), source, ``source_size``, ``target``, ``whole`` and ``taken``.

    Sources weigh ``weights`` in turn, by code point, null last. A source takes floor(target) words: every
    document ``whole`` times, and then documents in a seeded order once more until the words are reached; the
    document at the cut gives a part of its words. The cut is found by sums over ``SLICES`` slices of the order,
    and row by row in the one slice that holds it, so a source with a third of all rows is no single task.

    Nulls: a null text has no words, null sources are one source. Repeated rows are rows of their own. Sources
    without words have target 0. An empty table gives no rows.
    """
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    m = saved(rows.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), mark.alias("mark")), "mix-sizes")
    m = m.withColumn("slice", F.conv(F.substring("mark", 1, 3), 16, 10).cast("int"))
    slices = saved(m.groupBy("source", "slice").agg(F.sum("size").alias("words")), "mix-slices")
    sums = slices.groupBy("source").agg(F.sum("words").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array([F.lit(x).cast("long") for x in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    plan = water_fill(sums.withColumn("weight", weight), cap)
    plan = plan.withColumn("goal", F.floor(F.expr("num div den")).cast("long"))
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.expr("goal div source_size"), F.lit(cap))).otherwise(0).cast("long"))
    plan = saved(plan.withColumn("extra", F.col("goal") - F.col("whole") * F.col("source_size")).drop("num", "den", "goal"), "mix-plan")
    n = plan.count()
    by_slice = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    cut = slices.withColumn("before", F.coalesce(F.sum("words").over(by_slice), F.lit(0)))
    cut = cut.join(plan, cut["source"].eqNullSafe(plan["source"])).filter((F.col("before") < F.col("extra")) & (F.col("extra") <= F.col("before") + F.col("words")))
    cut = cut.select(plan["source"].alias("s"), F.col("slice").alias("cut"), "before")
    plan = plan.join(cut, plan["source"].eqNullSafe(cut["s"]), "left").drop("s").withColumnRenamed("source", "s")
    m = m.join(small(plan, n, 100_000), m["source"].eqNullSafe(plan["s"])).drop("s")
    within = Window.partitionBy("source").orderBy("mark", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = m.filter(F.col("slice") == F.col("cut")).withColumn("reached", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    at = at.withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("reached")))).drop("reached")
    # without a cut the extra is 0
    off = m.filter(~F.coalesce(F.col("slice") == F.col("cut"), F.lit(False))).withColumn("more", F.when(F.col("slice") < F.col("cut"), F.col("size")).otherwise(F.lit(0)))
    out = off.unionByName(at)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "whole", (F.col("whole") * F.col("size") + F.col("more")).cast("long").alias("taken"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row standing once for every whole repetition that :func:`mix` takes of it.

    The document at a source's cut, of which the mix takes a part, stands for that part if it is half or more.
    Rows without words stand once. ``mix`` is joined on the id, which must be unique; rows with a null id are
    mixed by a hash of their text as id, and rows that repeat an id stand each as often as the first of them.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.xxhash64(text_col).cast("string")))
    keyed = docs.withColumn("_mix_key", key)
    counts = mix(keyed, "_mix_key", text_col, source_col).groupBy("_mix_key").agg(F.max(F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1)).cast("int").alias("_mix_times"))
    times = F.explode(F.sequence(F.lit(1), F.col("_mix_times")))
    return keyed.join(counts, "_mix_key").filter("_mix_times > 0").withColumn("_mix_copy", times).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_water_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source").select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS mark FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w FROM s0),
s2 AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) - 3 * CAST(coalesce(sum(source_size) OVER b, 0) AS BIGINT) AS lw,
              CAST(sum(w) OVER () AS BIGINT) - CAST(coalesce(sum(w) OVER b, 0) AS BIGINT) AS lg
       FROM s1 WINDOW b AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, 3 * source_size * lg <= lw * w AS capped FROM s2),
f AS (SELECT lw AS flw, lg AS flg FROM s3 WHERE NOT capped ORDER BY source_size / w, source NULLS LAST LIMIT 1),
s4 AS (SELECT s3.source, source_size, CASE WHEN capped THEN 3 * source_size ELSE w * flw END AS num, CASE WHEN capped THEN 1 ELSE flg END AS den
       FROM s3 LEFT JOIN f ON true),
s5 AS (SELECT *, CAST(num AS DOUBLE) / CAST(den AS DOUBLE) AS target, num // den AS goal,
              CASE WHEN source_size > 0 THEN least((num // den) // source_size, 3) ELSE 0 END AS whole FROM s4),
r AS (SELECT d.doc_id, d.size, s5.source_size, s5.target, s5.whole, s5.goal - s5.whole * s5.source_size AS extra,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY mark, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(whole * size + greatest(0, least(size, extra - before)) AS BIGINT) AS taken FROM r
"""
