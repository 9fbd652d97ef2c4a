"""SimHash near-duplicates: fingerprints, vantage-point shards, and links between fingerprints."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.llm.common import dropped, saved, small, table
from veritab.llm.graph import components

#: Distinct fingerprints that one shard should own, and rows from which the driver chooses vantage points.
SHARD, SAMPLE = 8_000, 60_000


def _spread(h: np.ndarray, j: int) -> np.ndarray:
    """The j-th further hash of 64-bit hashes; the 0-th is the hash itself."""
    if j == 0:
        return h
    z = h + np.uint64(0x9E3779B97F4A7C15 * j % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: str | None, shingle: int, width: int = 1) -> tuple[list[int], int]:
    """``width`` 64-bit words of a text's SimHash and its number of shingles.

    A-Z is lowered, words are what lies between U+0020 and U+0009 to U+000D, a shingle is ``shingle`` words joined
    by a space (fewer words: all of them), hashed by XXH64 with seed 42. No words: all zero.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return [0] * width, 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    last = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    first = [0, *ends[: n - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(first, last, strict=True)), dtype=np.uint64, count=n)
    out = []
    for j in range(width):
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, n, 50_000):
            part = _spread(h[at : at + 50_000], j)
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0]))
    return out, n


def fingerprints(rows: DataFrame, text_col: str, shingle: int, width: int = 1) -> DataFrame:
    """``rows`` with ``f0`` to ``f{width-1}`` (64-bit words, signed) and ``shingles`` in place of the text."""
    names = [c for c in rows.columns if c != text_col]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    ordered = rows.select(*names, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [fingerprint(t.as_py(), shingle, width) for t in b.column(len(names))]
            words = [pa.array(np.array([f[j] for f, _ in got], dtype=np.uint64).view(np.int64)) for j in range(width)]
            cols = [b.column(i) for i in range(len(names))] + words + [pa.array([n for _, n in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *[f"f{j}" for j in range(width)], "shingles"])

    return ordered.mapInArrow(run, ", ".join(filter(None, [kinds, *[f"f{j} long" for j in range(width)], "shingles long"])))


def build_tree(sample: np.ndarray, leaves: int) -> list[tuple[int, int, int, int]]:
    """Vantage-point tree over sampled fingerprints: (vantage point, median distance, inside, outside) per node.

    A child below zero is the leaf ``-child - 1``. Each split takes, of a few candidates, the point whose
    distances spread most, and halves the sample at the median distance.
    """
    nodes: list[tuple[int, int, int, int]] = []
    count = [0]
    rng = np.random.default_rng(11)

    def grow(part: np.ndarray, want: int) -> int:
        if want > 1 and len(part) > 4:
            best = None
            for v in part[rng.integers(0, len(part), 6)]:
                d = np.bitwise_count(part ^ v)
                if best is None or d.std() > best[0]:
                    best = (d.std(), v, d)
            _, v, d = best
            mu = int(np.median(d))
            inside = d <= mu
            if 0 < inside.sum() < len(part):
                at = len(nodes)
                nodes.append((0, 0, 0, 0))
                nodes[at] = (int(v), mu, grow(part[inside], want // 2), grow(part[~inside], want - want // 2))
                return at
        count[0] += 1
        return -count[0]

    grow(sample, leaves)
    return nodes


def route(nodes: list[tuple[int, int, int, int]], f: np.ndarray, radius: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, rows, home) for all leaves that hold, or may hold within ``radius``, the fingerprints ``f``.

    A row's home is the one leaf of its own position; by the triangle inequality every fingerprint within
    ``radius`` of a row is at home in one of the leaves that the row visits.
    """
    every = np.arange(len(f))
    if not nodes:
        return [(0, every, np.ones(len(f), dtype=bool))]
    out, todo = [], [(0, every, np.ones(len(f), dtype=bool))]
    while todo:
        at, rows, home = todo.pop()
        if at < 0:
            out.append((-at - 1, rows, home))
            continue
        v, mu, inside, outside = nodes[at]
        d = np.bitwise_count(f[rows] ^ np.uint64(v)).astype(np.int64)
        a, b = d - radius <= mu, d + radius > mu
        todo.append((inside, rows[a], home[a] & (d[a] <= mu)))
        todo.append((outside, rows[b], home[b] & (d[b] > mu)))
    return out


class _Union:
    """Union-find over array positions, fed with blocks of links."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        r = self.root
        a, b = r[i], r[j]
        apart = a != b
        if not apart.any():
            return
        pairs = np.unique(np.stack([a[apart], b[apart]], axis=1), axis=0)

        def find(x: int) -> int:
            while r[x] != x:
                x = r[x]
            return x

        for a, b in pairs.tolist():
            x, y = find(a), find(b)
            if x != y:
                r[max(x, y)] = min(x, y)
        while (r[r] != r).any():
            r = r[r]
        self.root = r


class _First:
    """The first other position that each array position is linked to; ``n`` if there is none."""

    def __init__(self, n: int) -> None:
        self.first = np.full(n, n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        i, j = i[i != j], j[i != j]
        np.minimum.at(self.first, i, j)
        np.minimum.at(self.first, j, i)


def _join(f: np.ndarray, points: np.ndarray, queries: np.ndarray, radius: int, links: _Union | _First, depth: int = 0) -> None:
    """Link points and queries (positions in ``f``) within ``radius``: split by vantage points, then compare blocks."""
    if len(points) == 0 or len(queries) == 0:
        return
    if len(points) > 96 and depth < 40:
        v = f[points[len(points) // 2]]
        dp = np.bitwise_count(f[points] ^ v).astype(np.int64)
        mu = int(np.median(dp))
        inside = dp <= mu
        if inside.all():
            mu = int(dp.max()) - 1
            inside = dp <= mu
        if 0 < inside.sum() < len(points):
            dq = np.bitwise_count(f[queries] ^ v).astype(np.int64)
            _join(f, points[inside], queries[dq - radius <= mu], radius, links, depth + 1)
            _join(f, points[~inside], queries[dq + radius > mu], radius, links, depth + 1)
            return
    for p in range(0, len(points), 512):
        for q in range(0, len(queries), 4096):
            a, b = points[p : p + 512], queries[q : q + 4096]
            i, j = np.nonzero(np.bitwise_count(f[a][:, None] ^ f[b][None, :]) <= radius)
            links.add(a[i], b[j])


def _edges(lo: np.ndarray, links: _Union) -> pd.DataFrame:
    moved = np.flatnonzero(links.root != np.arange(len(lo)))
    return pd.DataFrame({"a": lo[moved], "b": lo[links.root[moved]]})


def link_fingerprints(points: DataFrame, radius: int) -> DataFrame:
    """(f0, lo) with distinct f0 -> (node, root): components over ``lo`` of fingerprints within ``radius`` bits.

    The driver builds the upper part of a vantage-point tree from a bounded sample; its leaves are the shards.
    Every fingerprint goes to its own leaf and to those that its ball of ``radius`` crosses; inside a leaf the
    tree goes on to small blocks, and a leaf gives each linked fingerprint one edge only, to its first one.
    """
    n = points.count()
    leaves = min(4096, math.ceil(n / SHARD)) if n else 1
    nodes = []
    if leaves > 1:
        picked = points.select("f0").orderBy(F.xxhash64("f0", F.lit("sample"))).limit(SAMPLE).toPandas()["f0"]
        nodes = build_tree(picked.to_numpy().view(np.uint64), leaves)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            f, lo = b["f0"].to_numpy(), b["lo"].to_numpy()
            for leaf, rows, home in route(nodes, f.view(np.uint64), radius):
                yield pd.DataFrame({"leaf": leaf, "home": home, "f0": f[rows], "lo": lo[rows]})

    def local(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("lo", kind="stable")
        f, links = b["f0"].to_numpy().view(np.uint64), _Union(len(b))
        _join(f, np.flatnonzero(b["home"].to_numpy()), np.arange(len(b)), radius, links)
        return _edges(b["lo"].to_numpy(), links)

    dealt = points.select("f0", "lo").mapInPandas(deal, "leaf int, home boolean, f0 long, lo long")
    return components(dealt.groupBy("leaf").applyInPandas(local, "a long, b long"))


def op4_vantage_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, "doc_id", "text", shingle=3, radius=2)


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id that the row reaches.

    Nulls: a null text has the fingerprint zero, like a text without words; rows with a null id are members of
    the component of their fingerprint, and have a null component if no id is there. Repeated rows all stay. An
    empty table gives no rows.
    """
    f = saved(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", shingle), "fingerprints")
    points = saved(f.groupBy("f0").agg(F.min("id").alias("lo")), "points")
    comp = link_fingerprints(points.filter("lo is not null"), radius)
    roots = points.join(comp, F.col("lo") == F.col("node"), "left").select(F.col("f0").alias("p0"), F.coalesce("root", "lo").alias("component_id"))
    out = f.join(roots, F.col("f0") == F.col("p0"))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


#: The near-duplicate stage: sets of shingles of five words, 512 bits, Jaccard of 0.8 or more.
STAGE_SHINGLE, STAGE_WIDTH, STAGE_SIMILARITY = 5, 8, 0.8
#: Documents sampled to learn which shingles are common, and common shingles that the driver hands to the tasks.
ORDER_SAMPLE, ORDER_TABLE = 20_000, 500_000
#: Differing bits of 512 up to which a pair is compared exactly. Jaccard 0.8 is expected to differ in 78 bits, and in 96
#: if the sets have 5 and 4 shingles; 160 is more than seven deviations above either.
STAGE_RADIUS = 160
#: Rows up to which ids are broadcast: some 20 MB.
BROADCAST = 500_000
#: Sets of a shingle that all others of it meet first.
HEADS = 8
#: Bits in which a word of two sets' SimHash may differ in the vantage-point shards, as in op4.
VANTAGE_RADIUS = 2


def bits_for(similarity: float, bits: int) -> int:
    """Differing bits that sets of one size and Jaccard ``similarity`` are expected to have."""
    return round(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted; words and hashes are those of :func:`fingerprint`."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    runs = {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in runs), dtype=np.uint64, count=len(runs)))


def set_bits(h: np.ndarray, width: int) -> list[int]:
    """``width`` signed 64-bit words of the SimHash of a set of hashes."""
    out = []
    for j in range(width):
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(h), 50_000):
            ones += np.unpackbits(_spread(h[at : at + 50_000], j).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view("<i8")[0]))
    return out


def common_shingles(slim: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of shingles that a sample of documents shares: at most ORDER_TABLE of them.

    They only order shingles; every order finds the same pairs, one with rare shingles first compares fewer.
    """
    step = max(1, slim.count() // ORDER_SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), shingle).view(np.int64))], names=["t"])

    part = slim.filter(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).select("text")
    top = part.mapInArrow(run, "t long").groupBy("t").agg(F.count(F.lit(1)).cast("int").alias("c")).filter("c >= 3").orderBy(F.desc("c"), "t").limit(ORDER_TABLE).toPandas()
    h, c = top["t"].to_numpy(dtype=np.int64).view(np.uint64), top["c"].to_numpy(dtype=np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def prefixes(slim: DataFrame, shingle: int, width: int, similarity: float) -> DataFrame:
    """(id, row, text) -> (id, row, k, n, prefix, f0..): digest and size of the set of shingles, its prefix, its SimHash.

    Two sets of Jaccard ``similarity`` share a shingle among the first n - ceil(similarity n) + 1 of either, in any
    order that all documents keep.
    """
    known, counts = common_shingles(slim, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(2):
                h = shingle_set(t.as_py(), shingle)
                rank = np.zeros(len(h), dtype=np.int64)
                if len(known) and len(h):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    rank = np.where(known[at] == h, counts[at], 0)
                first = len(h) - math.ceil(similarity * len(h) - 1e-9) + 1 if len(h) else 0
                rows.append((xxhash.xxh128_digest(h.tobytes()), len(h), h[np.lexsort((h, rank))[:first]].view(np.int64), *set_bits(h, width)))
            k, n, p, *f = zip(*rows, strict=True) if rows else [()] * (3 + width)
            cols = [b.column(0), b.column(1), pa.array(k, pa.binary()), pa.array(n, pa.int64()), pa.array(p, pa.list_(pa.int64())), *[pa.array(x, pa.int64()) for x in f]]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "row", "k", "n", "prefix", *[f"f{j}" for j in range(width)]])

    id_type = slim.schema["id"].dataType.simpleString()
    return slim.select("id", "row", "text").mapInArrow(run, ", ".join([f"id {id_type}, row long, k binary, n long, prefix array<long>", *[f"f{j} long" for j in range(width)]]))


def similar(pairs: DataFrame, points: DataFrame, slim: DataFrame, shingle: int, width: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of sets whose Jaccard is ``similarity`` or more, counted exactly."""
    f = [f"f{j}" for j in range(width)]
    side = lambda x: points.select(F.col("k").alias(x), *[F.col(c).alias(x + c) for c in f])
    bits = sum((F.bit_count(F.col("a" + c).bitwiseXOR(F.col("b" + c))) for c in f), F.lit(0))
    near = saved(pairs.join(side("a"), "a").join(side("b"), "b").filter(bits <= STAGE_RADIUS * width // 8).select("a", "b").distinct(), "near-pairs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), shingle).tobytes() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh128_digest(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], names=["k", "s"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fit = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                fit.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(fit, pa.bool_()))

    ends = near.select(F.col("a").alias("k")).union(near.select(F.col("b").alias("k"))).distinct()
    rows = saved(points.join(ends, "k", "left_semi").select("id", "row"), "pair-rows")
    texts = slim.join(small(rows, rows.count(), BROADCAST), ["id", "row"], "left_semi").select("text")
    sets = saved(texts.mapInArrow(cut, "k binary, s binary").dropDuplicates(["k"]), "shingle-sets")
    two = near.join(sets.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b")
    out = saved(two.select("a", "b", "sa", "sb").mapInArrow(judge, "a binary, b binary").distinct(), "similar-pairs")
    dropped(near, sets, rows)
    return out


def vantage_pairs(points: DataFrame, width: int, radius: int) -> DataFrame:
    """(k, f0..) -> pairs (a, b) of sets: each set and the first other one within ``radius`` bits of it, in any of the words.

    Each word has a vantage-point tree of its own, whose leaves are the shards, as in :func:`link_fingerprints`. Sets
    of one word are paired with the least of them, which alone stands for the word in the shards. The pairs are those
    of near fingerprints; their sets are still to be compared.
    """
    f = [f"f{j}" for j in range(width)]
    leaves = min(4096, math.ceil(points.count() / SHARD))
    trees = [[] for _ in f]
    if leaves > 1:
        picked = points.orderBy(F.xxhash64("k", F.lit("sample"))).limit(SAMPLE).select(*f).toPandas()
        trees = [build_tree(np.unique(picked[c].to_numpy().view(np.uint64)), leaves) for c in f]
    each = points.select("k", F.posexplode(F.array(*f)).alias("w", "f"))
    ones = saved(each.groupBy("w", "f").agg(F.min("k").alias("lo"), F.count(F.lit(1)).alias("c")), "words")

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for w, part in b.groupby("w"):
                f = part["f"].to_numpy()
                for leaf, rows, home in route(trees[w], f.view(np.uint64), radius):
                    yield pd.DataFrame({"w": w, "leaf": leaf, "home": home, "f": f[rows]})

    def local(b: pd.DataFrame) -> pd.DataFrame:
        f = np.sort(b["f"].to_numpy())
        home = np.flatnonzero(np.isin(f, b["f"][b["home"]].to_numpy()))
        links = _First(len(f))
        _join(f.view(np.uint64), home, np.arange(len(f)), radius, links)
        moved = np.flatnonzero(links.first < len(f))
        return pd.DataFrame({"w": b["w"].iloc[0], "x": f[links.first[moved]], "y": f[moved]})

    dealt = ones.select("w", "f").mapInPandas(deal, "w int, leaf int, home boolean, f long")
    near = dealt.groupBy("w", "leaf").applyInPandas(local, "w int, x long, y long").distinct()
    end = lambda c, name: ones.select("w", F.col("f").alias(c), F.col("lo").alias(name))
    near = near.join(end("x", "a"), ["w", "x"]).join(end("y", "b"), ["w", "y"]).select("a", "b")
    equal = each.join(ones.filter("c > 1"), ["w", "f"]).filter("k <> lo").select(F.col("lo").alias("a"), F.col("k").alias("b"))
    out = saved(near.unionByName(equal).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "vantage-pairs")
    dropped(ones)
    return out


def link_similar(points: DataFrame, slim: DataFrame, shingle: int, width: int, similarity: float) -> DataFrame:
    """(k, id, row, n, prefix, f0..) -> (node, root): components over the digests ``k`` of sets of Jaccard ``similarity``.

    Near fingerprints meet in vantage-point shards (:func:`vantage_pairs`), and their sets are compared. Sets that are
    similar, yet lie further apart than a radius that prunes, meet by shingles: on one of both prefixes, if size and
    places leave room for enough others. Only shingles whose sets are not all linked by then go into rounds:
    HEADS of their sets, chosen by hash, meet the sets that are not linked to them, and leave; each round has HEADS
    times as many. So a shingle of c sets is done after log(c) rounds, and linked sets cost no pairs. SimHash drops
    pairs far apart, and the sets of the others are compared.
    """
    near = vantage_pairs(points, width, VANTAGE_RADIUS)
    links = similar(near, points, slim, shingle, width, similarity)
    dropped(near)
    p = points.select("k", "n", F.posexplode("prefix").alias("i", "t"))
    shared = saved(p.groupBy("t").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("t"), "shared")  # few of the shingles; the others stay out of what follows
    p = saved(p.join(small(shared, shared.count(), 2 * BROADCAST), "t", "left_semi"), "shared-shingles")

    def room(n: Column, i: Column, m: Column, j: Column) -> Column:
        fits = F.least(n, m) >= similarity * F.greatest(n, m) - 1e-6
        return fits & (F.least(n - i, m - j) >= similarity / (1 + similarity) * (n + m) - 1e-6)

    pair = [F.least("k", "hk").alias("a"), F.greatest("k", "hk").alias("b")]
    left, most, seed = p.select("t", "k", "n", "i"), 1, 0
    while True:
        roots = saved(components(links), "roots")
        q = left.join(roots, F.col("k") == F.col("node"), "left").select("t", "k", "n", "i", F.coalesce("root", "k").alias("root"))
        mixed = q.groupBy("t").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("t")
        q = saved(q.join(mixed, "t", "left_semi"), "open-shingles")
        if q.isEmpty():
            dropped(p, shared, q)
            return roots
        most, seed = most * HEADS, seed + 1
        rank = F.row_number().over(Window.partitionBy("t").orderBy(F.xxhash64("k", F.lit(seed)), "k"))
        heads = saved(q.withColumn("o", rank).filter(F.col("o") <= most).select("t", F.col("k").alias("hk"), F.col("n").alias("hn"), F.col("i").alias("hi"), F.col("root").alias("hroot")), "shingle-heads")
        met = q.join(heads, "t").filter((F.col("root") != F.col("hroot")) & room(F.col("n"), F.col("i"), F.col("hn"), F.col("hi")))
        more = similar(met.select(*pair).distinct(), points, slim, shingle, width, similarity)
        both = saved(links.unionByName(more).distinct(), "similar-pairs")
        left = saved(q.join(heads, (q["t"] == heads["t"]) & (F.col("k") == F.col("hk")), "left_anti").select("t", "k", "n", "i"), "unmet-shingles")
        dropped(heads, roots, q, links, more)
        links = both


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = STAGE_SHINGLE, width: int = STAGE_WIDTH, similarity: float = STAGE_SIMILARITY) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest id stays, whole.

    Near are two texts whose sets of ``shingle``-word runs have a Jaccard of ``similarity`` or more. Texts without
    words, and rows with a null id, are nobody's near-duplicates and stay. Rows with one id are judged by their
    texts, each on its own; among rows of one group with the smallest id, the one with the least hash of all its
    columns stays, and of rows that are equal in every column one.
    """
    names = docs.columns
    row = F.xxhash64(*[F.col(f"`{c}`") for c in names])
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_d"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), row.alias("row"))
    other = F.col("id").isNull() | (F.length(F.translate(F.coalesce("text", F.lit("")), " \t\n\x0b\x0c\r", "")) == 0)
    slim = wide.filter(~other).select("id", "row", "text")
    f = saved(prefixes(slim, shingle, width, similarity), "prefixes")
    points = f.groupBy("k").agg(F.min(F.struct("id", "row")).alias("lo"), *[F.first(c).alias(c) for c in f.columns if c not in ("id", "row", "k")])
    points = saved(points.select("k", "lo.*", *[c for c in f.columns if c not in ("id", "row", "k")]), "points")
    twice = saved(f.groupBy("id", "row").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("id", "row"), "equal-rows")
    dropped(f)
    comp = link_similar(points, slim, shingle, width, similarity)
    group = points.join(comp, F.col("k") == F.col("node"), "left").groupBy(F.coalesce("root", "k").alias("g")).agg(F.min(F.struct("id", "row")).alias("lo"))
    group = saved(group.select("lo.*"), "kept-rows")
    n, n_twice = group.count(), twice.count()
    dropped(points)
    kept = wide.filter(~other).select("_d", "id", "row").join(small(group, n, BROADCAST), ["id", "row"], "left_semi")
    out = wide.filter(other).select("_d").unionByName(kept.join(small(twice, n_twice, BROADCAST), ["id", "row"], "left_anti").select("_d"))
    if n_twice:
        out = out.unionByName(kept.join(small(twice, n_twice, BROADCAST), ["id", "row"], "left_semi").dropDuplicates(["id", "row"]).select("_d"))
    return out.select("_d.*")
