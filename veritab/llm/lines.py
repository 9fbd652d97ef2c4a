"""Line dedup by content-defined chunks of lines."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm.common import dropped, saved, table

#: One line pair in STEP ends a chunk; a chunk that may go has at least LEAST lines.
STEP, LEAST = 3, 2
#: Parts over which the places of one hash are dealt, and places of a repeated chunk that one part should hold.
SALTS, PART = 8, 500


def lines_of(text: str | None) -> list[bytes]:
    """Lines of a text, each with its newline; joined they are the text's UTF-8."""
    lines = (text or "").encode().split(b"\n")
    return [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])


def chunks_of(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first line, line behind the last) of the chunks of a text.

    A chunk ends after line i if the hash of the hashes of lines i - 1 and i is 0 modulo STEP. A boundary depends on
    these two lines alone, so the chunks of a passage are found again wherever it stands, but for those at its ends.
    """
    out, start, before = [], 0, 0
    for i, line in enumerate(lines):
        h = xxhash.xxh64_intdigest(line.rstrip(b"\n"))
        if i and xxhash.xxh64_intdigest(h.to_bytes(8, "little") + before.to_bytes(8, "little")) % STEP == 0:
            out.append((start, i + 1))
            start = i + 1
        before = h
    return out + ([(start, len(lines))] if start < len(lines) else [])


def _covered(spans: list[dict] | None) -> set[int]:
    return {i for s in spans or () for i in range(s["a"], s["b"])}


def chunks_to_go(lines: list[bytes]) -> list[tuple[int, int, bytes]]:
    """(first line, line behind the last, bytes) of the chunks of LEAST lines or more that hold text."""
    return [(a, b, b"".join(lines[a:b])) for a, b in chunks_of(lines) if b - a >= LEAST and any(x.strip() for x in lines[a:b])]


def pairs_of(lines: list[bytes]) -> list[tuple[int, int, bytes]]:
    """(first line, line behind the last, digest) of neighbouring lines that are not blank; blank ones stand between at most.

    The digest is one that nobody can find two texts for, so equal digests count as equal bytes.
    """
    full = [i for i, x in enumerate(lines) if x.strip()]
    said = [lines[i].rstrip(b"\n") for i in full]
    return [(i, j + 1, hashlib.blake2b(x + b"\n" + y, digest_size=16).digest()) for i, j, x, y in zip(full, full[1:], said, said[1:], strict=False)]


def _batch(b: pa.RecordBatch, rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t or b.column(0).type) for c, t in zip(cols, kinds.values(), strict=True)], names=list(kinds))


def _shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, row, text) -> (id, row, idx, stop, h, h2): chunks by hash (h2 is null), and pairs of lines by both halves of a digest."""
    for b in batches:
        rows = []
        for i, r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if i is not None:
                lines = lines_of(t.as_py())
                rows += [(i, r, a, e, xxhash.xxh64_intdigest(c) - 2**63, None) for a, e, c in chunks_to_go(lines)]
                rows += [(i, r, a, e, *struct.unpack("<qq", h)) for a, e, h in pairs_of(lines)]
        yield _batch(b, rows, {"id": None, "row": pa.int64(), "idx": pa.int32(), "stop": pa.int32(), "h": pa.int64(), "h2": pa.int64()})


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([zstandard.compress((t.as_py() or "").encode(), 1) for t in b.column(2)], pa.binary())], names=["id", "row", "z"])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, row, z, places) -> (id, row, idx, stop, h, parts, bytes) of the chunks named by places."""
    for b in batches:
        rows = []
        for i, r, z, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
            lines = lines_of(zstandard.decompress(z.as_py()).decode())
            rows += [(i, r, p["idx"], p["stop"], p["h"], p["parts"], b"".join(lines[p["idx"] : p["stop"]])) for p in places]
        yield _batch(b, rows, {"id": None, "row": pa.int64(), "idx": pa.int32(), "stop": pa.int32(), "h": pa.int64(), "parts": pa.int32(), "bytes": pa.binary()})


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, z, gone, ends) -> (id, kept, n_lines, n_removed, n_chunks, n_pairs)."""
    for b in batches:
        rows = []
        for z, gone, ends in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            own, out = lines_of(zstandard.decompress(z.as_py()).decode()), _covered(gone) | _covered(ends)
            rows.append((b"".join(x for k, x in enumerate(own) if k not in out).decode(), len(own), len(out), len(gone or ()), len(ends or ())))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["id", "kept", "n_lines", "n_removed", "n_chunks", "n_pairs"])


def _chunks_gone(chunks: DataFrame, packed: DataFrame) -> DataFrame:
    """(id, row, gone): chunks whose bytes stand at an earlier place.

    Chunks are found by hash; those whose hash recurs are then fetched and compared byte by byte with the first of that
    hash. The places of a frequent chunk are dealt over several parts, each with its own copy of the first.
    """
    kind, place = chunks.schema["id"].dataType.simpleString(), F.struct("id", "row", "idx")
    many = chunks.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("f"), F.max(place).alias("l")).filter("f < l")
    many = many.select("h", F.least(F.lit(256), F.ceil(F.col("c") / PART)).cast("int").alias("parts"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    places = chunks.withColumn("salt", F.pmod(F.xxhash64("id", "idx"), F.lit(SALTS)).cast("int")).join(many, ["h", "salt"])
    places = places.groupBy("id", "row").agg(F.collect_set(F.struct("idx", "stop", "h", "parts")).alias("places"))
    got = packed.join(places, ["id", "row"]).select("id", "row", "z", "places").mapInArrow(_fetch, f"id {kind}, row long, idx int, stop int, h long, parts int, bytes binary")
    got = saved(got.withColumn("part", F.pmod(F.xxhash64("id", "row"), F.col("parts")).cast("int")), "repeated-chunks")
    low = got.groupBy("h").agg(F.min(place).alias("f"), F.max("parts").alias("parts"))
    first = got.join(low.select("h", "f.*"), ["h", "id", "row", "idx"], "left_semi").select("h", F.col("bytes").alias("first"), place.alias("f"), "parts").dropDuplicates(["h"])
    first = first.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    gone = got.join(first, ["h", "part"]).filter((F.col("bytes") == F.col("first")) & (place > F.col("f")))
    out = saved(gone.groupBy("id", "row").agg(F.collect_set(F.struct(F.col("idx").alias("a"), F.col("stop").alias("b"))).alias("gone")), "chunks-gone")
    dropped(got)
    return out


def _pairs_gone(pairs: DataFrame) -> DataFrame:
    """(id, row, ends): pairs of lines that stand at an earlier place, but for those that share a line with the first itself."""
    first = pairs.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "row", "idx", "stop")).alias("f")).filter("c > 1").drop("c")
    before = F.struct("f.id", "f.row", "f.idx")
    inside = (F.col("id") == F.col("f.id")) & (F.col("row") == F.col("f.row")) & (F.col("idx") < F.col("f.stop"))
    gone = pairs.join(first, ["h", "h2"]).filter((F.struct("id", "row", "idx") > before) & ~inside)
    return gone.groupBy("id", "row").agg(F.collect_set(F.struct(F.col("idx").alias("a"), F.col("stop").alias("b"))).alias("ends"))


def drop_repeated_chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kept, n_lines, n_removed, n_chunks, n_pairs): texts without multi-line passages that stand earlier.

    Of chunks with equal bytes the one with the smallest (id, text's hash, place) stays, see :func:`_chunks_gone`. What
    chunks leave of repeated passages, the lines at their ends and passages shorter than a chunk, goes by pairs of lines that
    stand earlier: so of a repeated passage of two lines or more with text nothing stays, and a line alone never goes.

    Nulls: a null text is empty; rows with a null id are kept whole and compared with nothing. Repeated rows with
    one id and text hold the same places, so neither removes the other; rows with one id and different texts are
    documents of their own. Ids of any ordered type. An empty table gives no rows. Blank lines go only between lines
    that go together.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("row"), F.col(f"`{text_col}`").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    shape = saved(slim.mapInArrow(_shape, f"id {kind}, row long, idx int, stop int, h long, h2 long"), "pieces")
    packed = slim.mapInArrow(_pack, f"id {kind}, row long, z binary")
    chunks = _chunks_gone(shape.filter("h2 is null"), packed)
    gone = chunks.join(_pairs_gone(shape.filter("h2 is not null")), ["id", "row"], "full")
    out = packed.join(gone, ["id", "row"], "left").select("id", "z", "gone", "ends").mapInArrow(_keep, f"id {kind}, kept string, n_lines long, n_removed long, n_chunks long, n_pairs long")
    return out.withColumnRenamed("id", id_col)


def op7_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return out.select("doc_id", "n_lines", "n_removed", "n_chunks", "n_pairs", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
