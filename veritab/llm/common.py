"""Small helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.sources.stage import dropped, saved, shared_dir

__all__ = ["SPACE", "WORD", "dropped", "let", "saved", "shared_dir", "small", "table"]

#: Words are runs of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``then`` as a lambda variable."""
    return F.transform(F.array(value), then)[0]


def small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast ``df`` if it has at most ``limit`` rows (counted by the caller), else leave the join to Spark."""
    return F.broadcast(df) if rows <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
