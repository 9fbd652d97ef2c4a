"""Removal of long byte strings that repeat across documents, by bucket-pointer refinement over anchored suffixes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm.common import saved, small, table

#: Bytes of a string that counts as repeated, bytes of an initial bucket, and places of a bucket in a string.
LENGTH, GRAM = 50, 16
PLACES = LENGTH - GRAM + 1
#: Bytes hashed at a time, and anchors after which a task sorts and sends what it has.
PIECE, FLUSH = 1 << 20, 1 << 19
#: Anchors that one bucket range should hold.
RANGE = 500_000
#: Open anchors of a bucket from which its strings are compared one by one, wherever they are, and not in one task.
HOT = 50_000

_rng = np.random.default_rng(20)
_LETTER = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            x = np.full(n, b, dtype=np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def _prefix(data: np.ndarray) -> np.ndarray:
    up, _ = _powers(max(PIECE + 4 * LENGTH, len(data)) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_LETTER[data] * up[: len(data)], out=out[1:])
    return out


def _hash(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [a, b); equal bytes have equal hashes wherever they stand."""
    return _mix((prefix[b] - prefix[a]) * _POWERS["down"][a] + (b - a).astype(np.uint64))


def _slide(x: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """f over every run of ``w`` neighbours."""
    k = 1
    while 2 * k <= w:
        x = f(x[:-k], x[k:])
        k *= 2
    return f(x[: len(x) - (w - k)], x[w - k :]) if w > k else x


def anchors(data: np.ndarray, owner: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, bucket keys and surroundings of the anchors of ``data``.

    ``owner`` numbers the documents in the buffer; ``first`` and ``last`` bound each in it. Of every string of
    LENGTH bytes inside one document the q-grams with the least hash are anchors, so equal strings have equal
    anchors at equal places. The surroundings of an anchor are all bytes of strings that it can anchor, as far
    as the document goes.
    """
    none = np.empty(0, dtype=np.int64)
    if len(data) < LENGTH:
        return none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = _prefix(data)
    n = len(data) - GRAM + 1
    down = _POWERS["down"]
    key = _mix((prefix[GRAM:] - prefix[:n]) * down[:n])
    low = _slide(key, PLACES, np.minimum)
    low[owner[: len(low)] != owner[LENGTH - 1 :]] = 0
    edge = np.zeros(PLACES - 1, dtype=np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([edge, low, edge]), PLACES, np.maximum) == key)
    at = at[(owner[at] == owner[at + GRAM - 1])]
    a = np.maximum(at - (PLACES - 1), first[owner[at]])
    b = np.minimum(at + LENGTH, last[owner[at]])
    around = _hash(prefix, a, b) + (at - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return at, key[at], around


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(texts, ids, offset of each text in its document): about PIECE bytes at a time, long texts in overlapping parts."""
    texts, ids, offs, size = [], [], [], 0
    step = PIECE - 3 * LENGTH
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            raw = (t.as_py() or "").encode()
            if len(raw) < LENGTH or i is None:
                continue
            for o in range(0, max(1, len(raw) - 3 * LENGTH), step):
                texts.append(raw[o : o + PIECE])
                ids.append(i)
                offs.append(o)
                size += len(texts[-1])
                if size >= PIECE:
                    yield texts, np.array(ids), np.array(offs)
                    texts, ids, offs, size = [], [], [], 0
    if texts:
        yield texts, np.array(ids), np.array(offs)


def _runs(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping ranges of one document made one."""
    if not len(doc):
        return doc, a, b
    o = np.lexsort((a, doc))
    doc, a, b = doc[o], a[o], b[o]
    new = np.ones(len(doc), dtype=bool)
    reach = np.maximum.accumulate(b + (np.cumsum(np.r_[True, doc[1:] != doc[:-1]]) << 40)) & ((1 << 40) - 1)
    new[1:] = (doc[1:] != doc[:-1]) | (a[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return doc[at], a[at], reach[np.r_[at[1:], len(doc)] - 1]


def _resolve(key: np.ndarray, around: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, copies, open) over anchors sorted by bucket, surroundings and document.

    A copy has the surroundings of an anchor in a document with a smaller id: all its strings are repeats. Open
    are anchors whose bucket is shared by documents but whose surroundings leave it undecided: the strings of
    the later ones have to be compared with those of the earlier ones.
    """
    o = np.lexsort((doc, around, key))
    k, s, d = key[o], around[o], doc[o]
    g = np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])]
    least = d[np.flatnonzero(g)][np.cumsum(g) - 1]
    copy = d > least
    kb = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    which = np.cumsum(np.r_[True, k[1:] != k[:-1]]) - 1
    many = np.add.reduceat(g.astype(np.int64), kb) > 1
    shared = np.minimum.reduceat(least, kb) < np.maximum.reduceat(least, kb)
    return o, copy, ~copy & (many & shared)[which]


def _find(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def send() -> Iterator[pa.RecordBatch]:
            key, around, doc, pos, left, right = (np.concatenate(x) for x in zip(*held, strict=True))
            o, copy, _ = _resolve(key, around, doc)
            c = o[copy]
            yield _range_rows(*_runs(doc[c], pos[c] - left[c], pos[c] + right[c]))
            o = o[~copy]
            part = (key[o] % np.uint64(ranges)).astype(np.int64)
            o = o[np.lexsort((pos[o], doc[o], part))]
            part = (key[o] % np.uint64(ranges)).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                x = o[a:b]
                blob = b"".join(v.tobytes() for v in (key[x], around[x], doc[x], pos[x].astype(np.int64), left[x].astype(np.uint8), right[x].astype(np.uint8)))
                rows.append((int(part[a]), b - a, zstandard.compress(_planes(blob, b - a), 1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()), *[pa.nulls(len(rows), pa.int64())] * 3],
                names=["part", "n", "blob", "doc", "a", "b"],
            )

        for texts, ids, offs in _pieces(batches):
            sizes = np.array([len(t) for t in texts])
            last = np.cumsum(sizes)
            first = last - sizes
            owner = np.repeat(np.arange(len(texts)), sizes)
            at, key, around = anchors(np.frombuffer(b"".join(texts), dtype=np.uint8), owner, first, last)
            w = owner[at]
            # a part's cut ends are no ends of the document; what touches them is whole in the neighbouring part
            left, right = np.minimum(at - first[w], PLACES - 1), np.minimum(last[w] - at, LENGTH)
            held.append((key & np.uint64(2**48 - 1), around, ids[w], at - first[w] + offs[w], left, right))
            count += len(at)
            if count >= FLUSH:
                yield from send()
                held, count = [], 0
        if count:
            yield from send()

    return run


def _planes(blob: bytes, n: int) -> bytes:
    """The five columns with the bytes of equal weight side by side, which compresses ids and positions well."""
    x = np.frombuffer(blob, dtype=np.uint8)
    wide = [x[i * 8 * n : (i + 1) * 8 * n].reshape(n, 8) for i in range(4)]
    near = np.diff(wide[3].copy().view(np.int64)[:, 0], prepend=0)
    same = np.diff(wide[2].copy().view(np.int64)[:, 0], prepend=0)
    cols = [wide[0], wide[1], same.view(np.uint8).reshape(n, 8), near.view(np.uint8).reshape(n, 8)]
    return b"".join([*[np.ascontiguousarray(c.T).tobytes() for c in cols], x[32 * n :].tobytes()])


def _columns(blob: bytes, n: int) -> tuple[np.ndarray, ...]:
    x = np.frombuffer(zstandard.decompress(blob), dtype=np.uint8)
    key, around, same, near = (np.ascontiguousarray(x[i * 8 * n : (i + 1) * 8 * n].reshape(8, n).T).view(np.uint64)[:, 0] for i in range(4))
    return key, around, np.cumsum(same.view(np.int64)), np.cumsum(near.view(np.int64)), x[32 * n : 33 * n].astype(np.int64), x[33 * n :].astype(np.int64)


def _range_rows(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays(
        [pa.array((doc % 1_000_003).astype(np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), *[pa.array(x.astype(np.int64)) for x in (doc, a, b)]],
        names=["part", "n", "blob", "doc", "a", "b"],
    )


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decide the anchors of whole bucket ranges: (doc, a, b, key), key null for a repeat, else still open at a."""
    held: dict[int, list[tuple[bytes, int]]] = {}  # a range is unpacked when its turn comes
    for batch in batches:
        for p, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            held.setdefault(p, []).append((blob.as_py(), n))
    while held:
        key, around, doc, pos, left, right = (np.concatenate(x) for x in zip(*[_columns(z, n) for z, n in held.popitem()[1]], strict=True))
        o, copy, wait = _resolve(key, around, doc)
        c, w = o[copy], o[wait]
        d, a, b = _runs(doc[c], pos[c] - left[c], pos[c] + right[c])
        none = pa.nulls(len(d), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(a), pa.array(b), none], names=["doc", "a", "b", "key"])
        yield pa.RecordBatch.from_arrays([pa.array(doc[w]), pa.array(pos[w]), pa.array(pos[w] + 1), pa.array(key[w].view(np.int64))], names=["doc", "a", "b", "key"])


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, places) -> (key, doc, pos, left, bytes): the surroundings of open anchors."""
    for b in batches:
        out: list[tuple] = []
        for doc, z, places in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
            raw = zstandard.decompress(z.as_py())
            for x in places:
                p = x["a"]
                s = max(0, p - PLACES + 1)
                out.append((x["key"], doc, p, p - s, raw[s : p + LENGTH]))
            if len(out) > 20_000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    k, d, p, s, t = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(d, pa.int64()), pa.array(p, pa.int64()), pa.array(s, pa.int32()), pa.array(t, pa.binary())], names=["key", "doc", "pos", "left", "bytes"])


def refine(key: np.ndarray, doc: np.ndarray, left: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """For every row the strings around its anchor that also occur in the bucket with a smaller document.

    Bucket pointers: the bucket of a row at an offset is the number of its q-gram among those of equal key at
    that offset (8 bytes first). Strings of up to twice the length get the number of the pair of buckets at an
    offset and at a later one, and each round reuses the numbers of the last, until equal numbers are equal
    strings of LENGTH bytes. Returns a boolean matrix: row, offset of the string's start before the anchor.
    """
    n = len(key)
    width = PLACES - 1 + LENGTH
    grid = np.zeros((n, width), dtype=np.uint8)
    size = np.array([len(t) for t in texts])
    flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
    start = PLACES - 1 - left
    row = np.repeat(np.arange(n), size)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    grid[row, col] = flat
    inside = np.zeros((n, width + 1), dtype=np.int32)
    np.add.at(inside, (row, col + 1), 1)
    inside = np.cumsum(inside, axis=1)

    def number(x: np.ndarray) -> np.ndarray:
        return np.unique(x, return_inverse=True)[1]

    at_key = number(key)
    bucket = [number(at_key * n + number(np.ascontiguousarray(grid[:, i : i + 8]).view(np.uint64)[:, 0])) for i in range(width - 7)]
    have = 8
    while have < LENGTH:
        step = min(have, LENGTH - have)
        bucket = [number(bucket[i] * n + bucket[i + step]) for i in range(width - have - step + 1)]
        have += step
    out = np.zeros((n, PLACES), dtype=bool)
    for i, b in enumerate(bucket):
        whole = np.flatnonzero(inside[:, i + LENGTH] - inside[:, i] == LENGTH)
        if len(whole) < 2:
            continue
        least = np.full(b.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, b[whole], doc[whole])
        out[whole, i] = doc[whole] > least[b[whole]]
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> (doc, a, b) of repeats; whole buckets, some ten thousand rows at a time."""
    def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        key, doc, pos, left = (t.column(c).to_numpy() for c in ("key", "doc", "pos", "left"))
        r, i = np.nonzero(refine(key, doc, left.astype(np.int64), t.column("bytes").to_pylist()))
        a = pos[r] - (PLACES - 1) + i
        d, a, b = _runs(doc[r], a, a + LENGTH)
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(a), pa.array(b)], names=["doc", "a", "b"])

    held, count = [], 0
    for b in batches:
        held.append(b)
        count += b.num_rows
        key = b.column(0).to_numpy()
        if count >= 30_000 and key[0] != key[-1]:
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1
            held[-1], rest = b.slice(0, cut), b.slice(cut)
            yield done(held)
            held, count = [rest], rest.num_rows
    if count:
        yield done(held)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc, pos, left, bytes) -> (doc, a, h, h2): the strings around open anchors, by both halves of a digest."""
    for b in batches:
        doc, at, digests = [], [], []
        for d, p, left, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
            for i in range(max(0, left - PLACES + 1), min(left, len(raw) - LENGTH) + 1):
                doc.append(d)
                at.append(p - left + i)
                digests.append(hashlib.blake2b(raw[i : i + LENGTH], digest_size=16).digest())
        h = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["doc", "a", "h", "h2"])


def _one_by_one(rows: DataFrame) -> DataFrame:
    """(doc, a, b) of the strings of open anchors that stand in a smaller document too.

    A string is known by a digest that nobody can find two strings for. Smallest documents are found with partial
    sums, and a string of any number of places meets its smallest document in as many tasks as Spark splits it into.
    """
    s = rows.mapInArrow(_strings, "doc long, a long, h long, h2 long")
    least = s.groupBy("h", "h2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most").drop("most")
    return s.join(least, ["h", "h2"]).filter("doc > least").select("doc", "a", (F.col("a") + LENGTH).alias("b")).distinct()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        z = [zstandard.compress((t.as_py() or "").encode(), 1) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z, pa.binary())], names=["id", "z"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, z, runs) -> (id, kept bytes, n_bytes, n_removed, n_spans)."""
    for b in batches:
        out = []
        for z, runs in zip(b.column(1), b.column(2).to_pylist(), strict=True):
            raw = zstandard.decompress(z.as_py())
            kept, at, removed, spans = [], 0, 0, 0
            for r in sorted(runs or (), key=lambda r: r["a"]):
                if r["a"] > at or not spans:
                    kept.append(raw[at : r["a"]])
                    spans += 1
                    at = r["a"]
                if r["b"] > at:
                    removed += r["b"] - at
                    at = r["b"]
            kept.append(raw[at:])
            kept_bytes = b"".join(kept)
            out.append((kept_bytes, len(raw), removed, spans))
        cols = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.binary()), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["id", "kept", "n_bytes", "n_removed", "n_spans"])


def remove_repeats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kept, n_bytes, n_removed, n_spans): texts as UTF-8 without what repeats an earlier document.

    A byte goes if it lies in a string of LENGTH bytes that also starts in a document with a smaller id, judged on
    the input. ``n_spans`` counts the maximal runs removed.

    1. Of every string the q-gram with the least hash is its anchor; anchors are dealt by their bucket (the hash
    of the q-gram) and each bucket splits by the hash of its surroundings: whoever is not first there is a copy.
    Copies inside one task's rows are taken out before the exchange. 2. Buckets that several documents share with
    different surroundings are refined by bucket pointers (:func:`refine`), on the bytes; buckets of HOT anchors or
    more never meet in one task, their strings are compared by digests (:func:`_one_by_one`).

    Nulls: a null text is empty; rows with a null id are returned whole and compared with nothing. Repeated rows
    with one id are one document's text twice, equal or not: neither removes the other. Texts of any length are
    read in overlapping parts. Ids that name different texts are returned whole too. An empty table gives no rows.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ids = slim.groupBy("id").agg(F.sum(F.octet_length("text")).alias("n"), (F.min(F.xxhash64("text")) < F.max(F.xxhash64("text"))).alias("mixed"))
    size, mixed = ids.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("mixed").cast("int")), F.lit(0))).first()
    judged = slim.join(ids.filter("mixed").select("id"), "id", "left_anti") if mixed else slim
    ranges = max(math.ceil(size / 17 / RANGE), int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = judged.mapInArrow(_find(ranges), "part int, n long, blob binary, doc long, a long, b long")
    blobs = found.repartition(ranges, "part")
    decided = blobs.mapInArrow(_first_meet, "doc long, a long, b long, key long")
    decided = saved(decided, "anchors")
    packed = slim.mapInArrow(_pack, "id long, z binary")
    waiting = decided.filter("key is not null")
    hot = saved(waiting.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HOT).select("key"), "hot-buckets")
    n_hot = hot.count()  # one bucket in HOT anchors at most

    def around(places: DataFrame) -> DataFrame:
        places = places.groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("key", "a")).alias("places"))
        return packed.join(places, "id").select("id", "z", "places").mapInArrow(_around, "key long, doc long, pos long, left int, bytes binary")

    cold = waiting.join(small(hot, n_hot, 100_000), "key", "left_anti") if n_hot else waiting
    more = around(cold).repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_compare, "doc long, a long, b long")
    if n_hot:
        more = more.unionByName(_one_by_one(around(waiting.join(small(hot, n_hot, 100_000), "key", "left_semi"))))
    runs = decided.filter("key is null").select("doc", "a", "b").unionByName(more)
    runs = runs.groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    out = packed.join(runs, "id", "left").select("id", "z", "runs").mapInArrow(_cut, "id long, kept binary, n_bytes long, n_removed long, n_spans long")
    return out.withColumnRenamed("id", id_col)


def _first_meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass on what a task decided by itself, and decide the rest."""
    def blobs() -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(2).is_null().to_numpy(zero_copy_only=False)
            ready = b.filter(pa.array(own))
            if ready.num_rows:
                passed.append(pa.RecordBatch.from_arrays([ready.column(3), ready.column(4), ready.column(5), pa.nulls(ready.num_rows, pa.int64())], names=["doc", "a", "b", "key"]))
            rest = b.filter(pa.array(~own))
            if rest.num_rows:
                yield rest

    passed: list[pa.RecordBatch] = []
    yield from _meet(blobs())
    yield from passed


def op10_bucket_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))



OP10_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
p AS (SELECT doc_id, h, unnest(range(0, greatest(n - 49, 0))) AS i FROM n),
g AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM p),
f AS (SELECT s, min(doc_id) AS m FROM g GROUP BY s),
r AS (SELECT g.doc_id, g.i FROM g JOIN f USING (s) WHERE f.m < g.doc_id),
o AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM r),
l AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
sp AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM l GROUP BY doc_id, run),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM sp),
k AS (SELECT q.doc_id, count(*) AS spans, sum(b - a) AS removed, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
      FROM q JOIN n USING (doc_id) GROUP BY q.doc_id)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM n LEFT JOIN k USING (doc_id)
"""
