"""The draft as the state of a stream: readings come in batches, each key keeps its draft, conflicts and manual values."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veritab.operators.draft import READINGS, STEPS, step, told

NAMES = [c.split()[0] for c in STEPS.split(", ")]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class DraftProcessor(StatefulProcessor):
    """One key's draft; what :func:`veritab.operators.draft.step` makes of it is written down after each batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.draft = handle.getValueState("draft", "draft string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        kept = self.draft.get()  # one call to the store, and one more if the draft changes: a batch has few readings of a key
        draft = before = json.loads(kept[0]) if kept else None
        for r in sorted(rows, key=lambda r: [(r[c] is not None, r[c]) if r[c] is not None else (False,) for c in ("seq", "kind", "source")]):
            draft, action = step(draft, r["kind"], r["source"], [{"form": x["form"], "value": x["value"]} for x in r["read"] or []])
            yield Row(**dict(zip(NAMES, told(key[0], r["seq"], draft, action), strict=True)))
        if draft is not before:
            self.draft.update((json.dumps(draft),))

    def close(self) -> None:
        pass


def drain(spark: SparkSession, readings: str, out: str, checkpoint: str, files: int = 1000) -> None:
    """Merge the reading files under ``readings`` that were not read before into drafts; each step is appended to ``out``.

    A batch reads ``files`` files; readings of a key must come in the order of ``seq``, batch after batch. The drafts
    live in the state store under ``checkpoint``, so a restart goes on where the last run ended, and the file sink
    takes a repeated batch once.
    """
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    stream = spark.readStream.schema(READINGS).option("maxFilesPerTrigger", files).parquet(readings).filter("key is not null")
    steps = stream.groupBy("key").transformWithState(DraftProcessor(), STEPS, "Append", "None")
    spark.conf.set(setting, ROCKS)
    try:
        steps.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, before)


def steps_of(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(STEPS).parquet(out)
