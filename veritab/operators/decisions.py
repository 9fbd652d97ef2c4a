"""Decisions as tables: each is joined to the latest state and either taken or refused with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")


def refusal(*guards: tuple[str, Column]) -> Column:
    """The reason of the first guard that does not hold (null counts as not holding); null if all hold."""
    out = None
    for reason, ok in guards:
        bad = ~F.coalesce(ok, F.lit(False))
        out = F.when(bad, reason) if out is None else out.when(bad, reason)
    return out


def decide(state: DataFrame, decisions: DataFrame, key: str, order: str, guards: list[tuple[str, Column]], changes: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(new state, log): the last decision of each key is applied if all guards hold on the joined row.

    Columns of the decisions are named ``d_...`` on the joined row. The log has the key and the refusal, null for what
    was done; a decision on an unknown key is refused as such.
    """
    last = latest(decisions, key, order)
    d = last.select(F.col(key).alias("_key"), *[F.col(c).alias(f"d_{c}") for c in last.columns if c != key], F.lit(True).alias("_asked"))
    j = state.withColumn("_known", F.lit(True)).join(d, F.col(key) == F.col("_key"), "full_outer")
    j = j.withColumn("_why", F.when(F.col("_asked"), refusal(("unknown", F.col("_known")), *guards)))
    done = F.coalesce(F.col("_asked"), F.lit(False)) & F.col("_why").isNull()
    new = j.filter("_known").select(*[F.when(done, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in state.columns])
    return new, j.filter("_asked").select(F.coalesce(key, "_key").alias(key), F.col("_why").alias("refused"))
