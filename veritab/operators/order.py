"""One order of the keys of many lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritab.sources.stage import dropped, saved


def precedence(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((key, rank), (a, b, w)) of lists (list, pos, key): keys by first appearance, and who stands before whom.

    Of each list a key's first place counts (ties: by key). A pair is two keys next to each other; ``w`` is how many
    more lists have it this way round than the other, and pairs without a majority are left out.
    """
    first = lists.filter("list is not null and key is not null").groupBy("list", "key").agg(F.min("pos").alias("pos"))
    keys = first.groupBy("key").agg(F.min(F.struct("list", "pos")).alias("rank"))
    pairs = first.withColumn("b", F.lead("key").over(Window.partitionBy("list").orderBy("pos", "key"))).filter("b is not null")
    one = F.col("key") < F.col("b")
    net = pairs.groupBy(F.least("key", "b").alias("x"), F.greatest("key", "b").alias("y")).agg(F.sum(F.when(one, 1).otherwise(-1)).alias("w")).filter("w <> 0")
    edges = net.select(F.when(F.col("w") > 0, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(F.col("w") > 0, F.col("y")).otherwise(F.col("x")).alias("b"), F.abs("w").alias("w"))
    return keys, edges


def merged_keys(lists: DataFrame) -> DataFrame:
    """(key, level, place): an order of all keys that keeps the order of the lists where they agree.

    Keys that nothing left stands before are laid down, all of a round on one level, and taken out of the graph. A
    round without such a key is a cycle: then the one goes that least stands before (ties: first appearance). Places
    go by level, then by first appearance (list, place in it, key). ``list`` and ``pos`` are ordered types; null lists and keys
    are left out, repeated keys of a list count at their first place.

    The tables of keys and pairs are aggregated before the rounds and do not grow with the lists; there are as many
    rounds as the longest chain has keys, and each is written to the shared folder.
    """
    keys, edges = precedence(lists)
    left, edges = saved(keys, "keys"), saved(edges, "pairs")
    levels, done = [], []
    level = 0
    while True:
        live = edges.join(left.select(F.col("key").alias("a")), "a", "left_semi").join(left.select(F.col("key").alias("b")), "b", "left_semi")
        before = live.groupBy(F.col("b").alias("key")).agg(F.sum("w").alias("w"))
        scored = left.join(before, "key", "left").withColumn("w", F.coalesce("w", F.lit(0).cast("long")))
        least = scored.agg(F.min(F.struct("w", "rank", "key")).alias("least"))  # one row
        out = (F.col("w") == 0) | ((F.col("least.w") > 0) & (F.col("key") == F.col("least.key")))
        now = saved(scored.join(F.broadcast(least)).select("key", "rank", out.alias("out")), "level")
        done.append(now)
        if now.isEmpty():
            break
        levels.append(now.filter("out").select("key", "rank", F.lit(level).alias("level")))
        left, level = now.filter("not out").select("key", "rank"), level + 1
    if not levels:
        return keys.select("key", F.lit(0).alias("level"), F.lit(0).cast("long").alias("place")).limit(0)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    out = saved(out, "levels")
    dropped(edges, *done)
    # a level is a part of its own, so places are numbered without one window over all keys
    size = out.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    start = size.alias("s").join(size.alias("t"), F.col("t.level") < F.col("s.level"), "left").groupBy(F.col("s.level").alias("level")).agg(F.coalesce(F.sum("t.n"), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("level").orderBy("rank", "key"))
    return out.join(start, "level").select("key", "level", (F.col("start") + nth - 1).cast("long").alias("place"))
