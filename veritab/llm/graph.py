"""Connected components as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm.common import dropped, saved


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a > b): neighbours move to the smallest node around each node."""
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges
    low = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    near = around.join(low, "a")
    if large:
        near = near.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        near = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return near.filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): the smallest node that each node of an edge reaches, for nodes that are not roots.

    Large and small stars in turn until the edges no longer change; every round is written to the shared folder.
    Null ends and loops are left out; an empty table gives an empty result.
    """
    now = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or seen[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen
        after = saved(_stars(saved_large := saved(_stars(now, True), "edges"), False), "edges")
        dropped(now, saved_large)
        now = after
