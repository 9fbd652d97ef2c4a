"""Numbers for real values that last: known ones keep theirs, new ones go behind the last, and a map counts only once it is checked."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.operators.sinks import Versions
from veritab.sources.stage import dropped, saved

MAP = "kind string, key string, number long, run long"


class PseudonymMap(Versions):
    """Versions of a map (kind, key, number, run)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__(spark, path, MAP)

    def extended(self, found: DataFrame) -> tuple[str, DataFrame]:
        """(name, map) of a new version: the current map, and numbers behind its last ones for what it does not have.

        ``found`` (kind, key) in any number; nulls are left out. New keys of a kind are numbered in their order,
        by sorted partitions with offsets, so no task sees all of them.
        """
        now = self.current()
        new = found.select("kind", "key").filter("kind is not null and key is not null").distinct().join(now, ["kind", "key"], "left_anti")
        placed = new.repartitionByRange("kind", "key").sortWithinPartitions("kind", "key")
        placed = saved(placed.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "new-keys")
        size = placed.groupBy("kind", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))  # one row a part
        before = F.coalesce(F.sum("n").over(Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        last = now.groupBy("kind").agg(F.max("number").alias("last"))
        start = size.withColumn("before", before).join(last, "kind", "left").select("kind", "part", "first", (F.col("before") + F.coalesce("last", F.lit(0))).alias("start"))
        rows = placed.join(start, ["kind", "part"]).select("kind", "key", (F.col("start") + F.col("at") - F.col("first") + 1).alias("number"), F.lit(self.run() + 1).cast("long").alias("run"))
        name = self.write(now.unionByName(rows))
        dropped(placed)
        return name, self.version(name)


def _put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, marks) -> (id, text) with each (start, stop, shown) put in its place."""
    for b in batches:
        out = []
        for t, marks in zip(b.column(1), b.column(2).to_pylist(), strict=True):
            text, parts, at = t.as_py(), [], 0
            for m in sorted(marks or (), key=lambda m: m["start"]):
                parts += [text[at : m["start"]], m["shown"]]
                at = m["stop"]
            out.append(text if text is None else "".join([*parts, text[at:]]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["id", "text"])


def replaced(docs: DataFrame, id_col: str, text_col: str, spans: DataFrame, numbers: DataFrame, shown: Callable) -> DataFrame:
    """(id, text): texts with their spans replaced by ``shown(kind, number)``.

    ``spans`` (id, start, stop, kind, key) do not overlap, see :func:`veritab.operators.known.personal_spans`. Spans
    without a number stay as they are. Time is linear in a text and its spans. Ids name one text each; null texts stay.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    marks = spans.join(numbers.select("kind", "key", "number"), ["kind", "key"]).select(F.col(f"`{id_col}`").alias("id"), "start", "stop", shown(F.col("kind"), F.col("number")).alias("shown"))
    marks = marks.groupBy("id").agg(F.collect_set(F.struct("start", "stop", "shown")).alias("marks"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(marks, "id", "left")
    return rows.select("id", "text", "marks").mapInArrow(_put, f"id {kind}, text string").withColumnRenamed("id", id_col)
