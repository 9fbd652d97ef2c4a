"""Writes whose meaning is more than an append."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_by_key(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replace the partitions of the keys that ``df`` has; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append_only(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upsert_add(stored: DataFrame, new: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """``stored`` with the amounts of ``new`` added by key."""
    return stored.select(*keys, amount).unionByName(new.select(*keys, amount)).groupBy(*keys).agg(F.sum(amount).alias(amount))


def unread(pieces: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces whose content hash is not in the cache."""
    return pieces.join(cache.select(*keys).distinct(), keys, "left_anti")


def manifest(files: DataFrame, name: str, content: str) -> DataFrame:
    """One JSON line per file: name, bytes, SHA-256."""
    return files.select(F.to_json(F.struct(F.col(name).alias("name"), F.octet_length(content).alias("bytes"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))).alias("entry"))


class AuditLog:
    """Rows that are only ever added: there is a way to append and to read, and the others refuse."""

    def __init__(self, path: str) -> None:
        self.path = path

    def append(self, df: DataFrame) -> None:
        append_only(df, self.path)

    def rows(self, like: DataFrame) -> DataFrame:
        return like.sparkSession.read.schema(like.schema).parquet(self.path)

    def update(self, *_: object) -> None:
        raise PermissionError("an audit log is not changed")

    delete = truncate = update


class Versions:
    """Versions of a table under a path, and a pointer to the one that counts.

    A version is written whole, beside the others; ``point`` appends its name to the pointer, one small file, so
    readers see the old table or the new one and nothing between. A version that no pointer names is never read.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def _pointers(self) -> list[tuple[int, str]]:
        jvm = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointer")
        if not jvm.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jvm):
            return []
        return sorted(tuple(r) for r in self.spark.read.schema("run long, version string").parquet(f"{self.path}/pointer").collect())  # one row a run

    def run(self) -> int:
        """Versions that counted so far."""
        return max((r for r, _ in self._pointers()), default=0)

    def current(self) -> DataFrame:
        known = self._pointers()
        return self.version(known[-1][1]) if known else self.spark.createDataFrame([], self.schema)

    def version(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}")

    def write(self, df: DataFrame) -> str:
        """The name of a new version, which does not count yet."""
        name = f"version-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def swap(self, name: str, residues: DataFrame) -> int:
        """Make a version the current one if ``residues`` has no rows; otherwise the old one stays. How many there are."""
        left = residues.count()
        if not left:
            self.spark.createDataFrame([(self.run() + 1, name)], "run long, version string").coalesce(1).write.mode("append").parquet(f"{self.path}/pointer")
        return left


def staged(df: DataFrame, path: str, residue) -> int:
    """Write ``df`` as a new version under ``path`` that counts only if ``residue(df)`` finds nothing in what was written."""
    table = Versions(df.sparkSession, path, df.schema)
    name = table.write(df)
    return table.swap(name, residue(table.version(name)))
