"""Histogram sort: put rows into shards of near-equal bytes with one exchange."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.llm.common import saved, small, table

LOW, HIGH = -(2**63), 2**63 - 1


def _below(keys: DataFrame, probes: np.ndarray) -> np.ndarray:
    """Exact bytes of the rows whose key lies below each probe; one small row per probe and partition moves."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(probes) + 1, dtype=np.int64)
        for b in batches:
            np.add.at(total, np.searchsorted(probes, b["k"].to_numpy(), side="right"), b["size"].to_numpy())
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at.astype(np.int32), "bytes": total[at]})

    got = keys.select("k", "size").mapInPandas(count, "at int, bytes long").groupBy("at").agg(F.sum("bytes").alias("bytes"))
    out = np.zeros(len(probes) + 1, dtype=np.int64)
    for r in got.collect():  # at most one row per probe
        out[r["at"]] = r["bytes"]
    return np.cumsum(out)[:-1]


def splitters(keys: DataFrame, goals: list[int], total: int, tolerance: int, probes: int = 48) -> list[int]:
    """Key boundaries such that the bytes below boundary i differ from ``goals[i]`` by ``tolerance`` at most.

    Each round counts the exact bytes below ``probes`` evenly spaced keys inside every open interval and keeps
    the step that holds the goal, until a probe is near enough or two neighbouring keys remain (then the nearer
    of the two edges is taken). A round reads keys and sizes only.
    """
    lo, hi = [LOW] * len(goals), [HIGH] * len(goals)
    lo_b, hi_b = [0] * len(goals), [total] * len(goals)
    done: dict[int, int] = {i: LOW for i, g in enumerate(goals) if total == 0 or g <= 0} | {i: HIGH for i, g in enumerate(goals) if g >= total > 0}
    while len(done) < len(goals):
        mine = {i: sorted({lo[i] + (hi[i] - lo[i]) * j // (probes + 1) for j in range(1, probes + 1)} - {lo[i]}) for i in range(len(goals)) if i not in done}
        every = np.array(sorted({p for v in mine.values() for p in v}), dtype=np.int64)
        below = dict(zip(every.tolist(), _below(keys, every).tolist(), strict=True)) if len(every) else {}
        for i, points in mine.items():
            for p in points:
                if below[p] <= goals[i] and p > lo[i]:
                    lo[i], lo_b[i] = p, below[p]
                elif below[p] > goals[i]:
                    hi[i], hi_b[i] = p, below[p]
                    break
            near, off = (lo[i], goals[i] - lo_b[i]) if goals[i] - lo_b[i] <= hi_b[i] - goals[i] else (hi[i], hi_b[i] - goals[i])
            if off <= tolerance or hi[i] - lo[i] <= 1:
                done[i] = near
    return [done[i] for i in range(len(goals))]


def place(rows: DataFrame, shards: int, tolerance: float) -> DataFrame:
    """``rows`` (id, size, g: hash of the text, any more) with ``shard`` and ``slot``, exchanged once.

    The sort key is the hash of the text, so equal texts are neighbours. A group of equal texts that is heavier than
    ``tolerance`` of a shard (at most ``shards / tolerance`` such groups exist) is placed whole, largest first, into
    the lightest shard if it has room; otherwise its rows are spread by id, since whole groups and near-equal bytes
    exclude each other there. The rest is cut by :func:`splitters` to what each shard still lacks. Histograms, groups
    and counts are taken from a narrow table of keys; the rows themselves move when they are numbered, by sub-ranges
    of a shard, so no task sees a whole shard.
    """
    spark = rows.sparkSession
    unit = F.xxhash64("id")
    keys = saved(rows.select("size", "g", unit.alias("u")), "shard-keys")
    total, n = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    share = total / shards
    heavy = keys.groupBy("g").agg(F.sum("size").alias("b")).filter(F.col("b") > max(1.0, share * tolerance)).collect() if n else []
    load, placed, spread = [(0, s) for s in range(shards)], {}, []
    for r in sorted(heavy, key=lambda r: (-r["b"], r["g"])):
        if load[0][0] + r["b"] > share * (1 + tolerance / 2):
            spread.append(r["g"])
            continue
        b, s = heapq.heappop(load)
        placed[r["g"]] = s
        heapq.heappush(load, (b + r["b"], s))
    lack = [max(0.0, share - b) for b, _ in sorted(load, key=lambda x: x[1])]
    fixed = spark.createDataFrame([(g, s) for g, s in placed.items()] + [(g, -1) for g in spread], "g long, home int")

    def keyed(t: DataFrame) -> DataFrame:
        return t.join(F.broadcast(fixed), "g", "left").withColumn("k", F.when(F.col("home") == -1, F.xxhash64("g", "u")).otherwise(F.col("g")))  # shards / tolerance rows at most

    light = keyed(keys).filter(F.coalesce("home", F.lit(-1)) == -1)
    rest = int(light.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    goals = [int(rest * x) for x in np.cumsum(lack)[:-1] / max(sum(lack), 1e-9)]
    cuts = splitters(light, goals, rest, int(share * tolerance / 4)) if n else [LOW] * (shards - 1)
    edges = np.maximum.accumulate(np.array(cuts, dtype=np.int64)).tolist() if shards > 1 else []
    subs = max(16, n // (shards * 50_000))
    low = F.array(*[F.lit(float(x)) for x in (LOW, *edges)])
    wide = F.array(*[F.lit(max(1.0, float(b) - float(a))) for a, b in zip((LOW, *edges), (*edges, HIGH), strict=True)])
    bounds = F.array(*[F.lit(x) for x in edges]) if edges else F.array().cast("array<bigint>")

    def dealt(t: DataFrame) -> DataFrame:
        t = keyed(t).withColumn("shard", F.coalesce(F.nullif("home", F.lit(-1)), F.size(F.filter(bounds, lambda e: e <= F.col("k")))).cast("int"))
        part = F.floor((F.col("k") - F.get(low, F.col("shard"))) / F.get(wide, F.col("shard")) * subs)
        inside = F.greatest(F.lit(0), F.least(part, F.lit(subs - 1)))
        return t.withColumn("sub", F.when(F.col("home") >= 0, subs + F.pmod("u", F.lit(subs))).otherwise(inside).cast("int"))

    counts = dealt(keys).groupBy("shard", "sub").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1))
    base = saved(counts.select("shard", "sub", F.coalesce(before, F.lit(0)).alias("base")), "shard-counts")
    in_order = Window.partitionBy("shard", "sub").orderBy("k", F.col("id").asc_nulls_first(), "size", F.xxhash64(*[c for c in rows.columns if c not in ("g", "size")]))
    out = dealt(rows.withColumn("u", unit)).withColumn("at", F.row_number().over(in_order))
    out = out.join(small(base, base.count(), 2_000_000), ["shard", "sub"])
    return out.select(*rows.columns, "shard", (F.col("base") + F.col("at") - 1).cast("long").alias("slot"))


def _measured(id_col: str, text_col: str) -> list:
    text = F.col(f"`{text_col}`")
    return [
        F.col(f"`{id_col}`").alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("g"),
    ]


def histogram_shards(rows: DataFrame, id_col: str, text_col: str, shards: int = 40, tolerance: float = 0.01) -> DataFrame:
    """Ids of ``rows`` with ``size``, ``text_crc32``, ``shard`` and ``slot``, as :func:`place` deals them.

    Nulls: a null text has size 16 and CRC 0; a null id is an id of its own. Repeated rows are all kept. An empty
    table gives no rows.
    """
    out = place(rows.select(*_measured(id_col, text_col)), shards, tolerance)
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, tolerance: float = 0.01) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``; whole documents are exchanged once.

    Repeated rows are all kept, each with a slot. Columns of ``docs`` named shard or slot are replaced.
    """
    docs = docs.drop("shard", "slot")
    wide = docs.select(*_measured(id_col, text_col), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d"))
    return place(wide, shards, tolerance).select("_d.*", "shard", "slot")


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = histogram_shards(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
