"""Seconds per user and step, kept up as events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A heartbeat counts as this many seconds at most.
HEARTBEAT = 60
KEYS = ["user_id", "step", "day"]


def step_seconds(events: DataFrame) -> DataFrame:
    """Batch or streaming events (ts, user_id, event_type, value) -> seconds by user, step and day."""
    spent = F.least(F.greatest(F.round("value").cast("long"), F.lit(0)), F.lit(HEARTBEAT)).cast("long")
    return events.groupBy("user_id", F.col("event_type").alias("step"), F.to_date("ts").alias("day")).agg(F.sum(spent).alias("seconds"), F.count(F.lit(1)).alias("beats"))


def late_counts(events: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events per window and type, with a watermark for late rows."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


class Ledger:
    """Totals that take each batch once: what a batch adds lies under its number, and a ledger tells which numbers count.

    ``add`` writes a batch's sums in place of what a failed try left under the same number, and then its number into
    the ledger; a batch that comes again finds its number there and adds nothing. Readers sum what the ledger names,
    so they never see half a batch. ``fold`` sums all batches so far into one, which lowers what readers sum.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str] = KEYS) -> None:
        self.spark, self.path, self.keys = spark, path, keys

    def entries(self) -> list[tuple[str, int, int]]:
        """(kind, first, last) of the batches that count: one row a batch, until they are folded."""
        known = self.spark.createDataFrame([], "kind string, first long, last long")
        jvm = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/ledger")
        if jvm.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jvm):
            known = self.spark.read.schema(known.schema).parquet(f"{self.path}/ledger")
        rows = sorted({tuple(r) for r in known.collect()})
        upto = max((r[2] for r in rows if r[0] == "folded"), default=-1)
        return [r for r in rows if r == ("folded", 0, upto) or r[0] == "batch" and r[1] > upto]

    def _note(self, kind: str, first: int, last: int) -> None:
        self.spark.createDataFrame([(kind, first, last)], "kind string, first long, last long").coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")

    def add(self, sums: DataFrame, number: int) -> bool:
        """Whether the batch was new."""
        if any(first <= number <= last for _, first, last in self.entries()):
            return False
        sums.write.mode("overwrite").parquet(f"{self.path}/batch-{number}")
        self._note("batch", number, number)
        return True

    def totals(self, like: DataFrame | None = None) -> DataFrame:
        """Sums over all batches that count; ``like`` gives the columns while there are none."""
        parts = [f"{self.path}/{kind}-{last}" for kind, _, last in self.entries()]
        if not parts:
            if like is None:
                raise ValueError("no batch yet")
            return like.limit(0)
        rows = self.spark.read.parquet(*parts)
        return rows.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in self.keys])

    def fold(self) -> None:
        last = max((r[2] for r in self.entries()), default=None)
        if last is not None:
            self.totals().write.mode("overwrite").parquet(f"{self.path}/folded-{last}")
            self._note("folded", 0, last)


def run_once(spark: SparkSession, path: str, out: str, checkpoint: str, files: int = 1000) -> Ledger:
    """Drain the event files under ``path`` that were not read before into a :class:`Ledger` of sums.

    Each batch is summed on its own (no state that grows, append mode) and added once, however often it is tried.
    """
    schema, ledger = spark.read.parquet(path).schema, Ledger(spark, out)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    put = lambda batch, number: ledger.add(step_seconds(batch), number)
    stream.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return ledger
