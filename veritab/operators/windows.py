"""Order-bound operators. The order is always a column; Spark rows have none of their own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.sources.stage import saved


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def fill_forward(value: Column, present: Column, keys: list[str], *order: Column) -> Column:
    """The value of the last row that is ``present``; a present null resets the fill."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(F.when(present, F.struct(value.alias("v"))), ignorenulls=True).over(w)["v"]


def anchored_groups(rows: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """(key, first, n): values of a key cut where one lies more than ``tolerance`` after the first value of its group.

    Equal values are counted first. Then each task walks its keys in order and holds one group at a time, so a key of
    any size needs no memory. Null values are left out.
    """
    kind = rows.schema[key].dataType.simpleString()
    counted = rows.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).filter("v is not null").groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: tuple | None = None
        for b in batches:
            out = []
            for k, v, c in zip(b["k"], b["v"], b["c"], strict=True):
                if open_ and open_[0] == k and v - open_[1] <= tolerance:
                    open_ = (k, open_[1], open_[2] + c)
                else:
                    out += [open_] if open_ else []
                    open_ = (k, v, c)
            yield pd.DataFrame(out, columns=[key, "first", "n"])
        if open_:
            yield pd.DataFrame([open_], columns=[key, "first", "n"])

    return counted.repartition("k").sortWithinPartitions("k", "v").mapInPandas(run, f"{key} {kind}, first double, n long")


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in the order of columns that tell its rows apart.

    Rows are sorted in parts by ranges and written; each part goes on where those before it end, so only the table of
    parts, one row each, is ordered as a whole.
    """
    t = df.repartitionByRange(*order).sortWithinPartitions(*order)
    t = saved(t.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "numbered")
    parts = t.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_first"))
    ahead = F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = parts.withColumn("_base", ahead).select("_part", (F.col("_base") - F.col("_first") + 1).alias("_base"))
    return t.join(F.broadcast(base), "_part").select(*df.columns, (F.col("_at") + F.col("_base")).alias(name))


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, right_at: str, values: list[str]) -> DataFrame:
    """Each left row with the ``values`` of the last right row of its key at or before it: one union, one window."""
    pick = F.struct(F.col(right_at).alias("_t"), *values)
    l = left.select(by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(pick).schema[0].dataType).alias("_r"))  # noqa: E741
    r = right.select(by, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"), pick.alias("_r"))
    w = Window.partitionBy(by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = l.unionByName(r).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    return out.select("_l.*", *[F.col(f"_r.{v}").alias(v) for v in values])
