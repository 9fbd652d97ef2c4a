"""Summaries of facts: matrices, ranges of pages, samples of evidence, weighted reductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coherence_matrix(facts: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """One row per ``row``: the distinct values of each column joined by " / ", and whether columns differ."""
    cell = F.array_join(F.sort_array(F.collect_set(value)), " / ")
    out = facts.groupBy(row).pivot(column, columns).agg(cell)
    filled = F.filter(F.array(*[F.nullif(F.col(f"`{c}`"), F.lit("")) for c in columns]), lambda x: x.isNotNull())
    return out.withColumn("differs", F.size(F.array_distinct(filled)) > 1)


def compressed(pages: Column) -> Column:
    """Sorted distinct integers as ranges: 1-3, 5, 7-8."""
    s = F.array_sort(F.array_distinct(pages))
    starts = F.filter(s, lambda x: ~F.array_contains(s, x - 1))
    ends = F.filter(s, lambda x: ~F.array_contains(s, x + 1))
    return F.array_join(F.zip_with(starts, ends, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a.cast("string"), b.cast("string")))), ", ")


def evidence(df: DataFrame, code: str, groups: list[str], order: str, most: int) -> DataFrame:
    """Of each code: the first of every group, then the others, ``most`` at most, numbered ``place``."""
    first = F.row_number().over(Window.partitionBy(code, *groups).orderBy(order)) == 1
    place = F.row_number().over(Window.partitionBy(code).orderBy(F.col("_first").desc(), order))
    return df.withColumn("_first", first).withColumn("place", place).filter(F.col("place") <= most).drop("_first")


def guarded_sum(value: Column, unit: Column) -> Column:
    """The sum if there is one unit, else null."""
    return F.when(F.count_distinct(unit) <= 1, F.sum(value))
