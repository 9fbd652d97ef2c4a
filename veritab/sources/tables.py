"""Tables of a folder, and the long facts that the checks read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def facts(df: DataFrame, project: str, piece: str, keys: dict[str, str], order: str) -> DataFrame:
    """Long facts (project, piece, ord, key, value_text) of the columns ``keys`` (key -> column); nulls are no facts."""
    each = F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value_text")) for k, c in keys.items()])
    out = df.select(F.col(project).alias("project"), F.col(piece).alias("piece"), F.col(order).alias("ord"), F.explode(each).alias("f"))
    return out.select("project", "piece", "ord", "f.key", "f.value_text").filter("value_text is not null")
