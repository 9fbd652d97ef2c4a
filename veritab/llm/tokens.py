"""Token counts by the library of a tokenizer; huge texts in overlapping chunks that are spliced at stable boundaries."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.llm.common import dropped, saved, small, table

#: Code points of a chunk, and bytes from which a text is cut into chunks.
CHUNK, HUGE = 16_384, 49_152
#: Code points of the overlap of two chunks; the next is taken where the chunks do not come together, then all.
OVERLAPS = (256, 4_096)
#: Stretches that a worker process remembers with their number of tokens, and the longest of them.
WORDS, LONGEST = 1_000_000, 64
#: Huge texts whose counts are broadcast when they meet their documents.
FEW = 50_000
#: Places where no token lies across, whatever stands further off: before a blank or line end that follows anything
#: but white space (of Python's kind, which holds all of the library's).
STABLE = re.compile(r"(?<=\S)[ \t\n\r]")
#: Stretches between such places.
STRETCH = re.compile(r"\s*\S+(?:[^\S \t\n\r]\s*\S+)*|\s+")


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


class _Words(dict):
    """Word -> its number of tokens; forgets all when it grows beyond WORDS."""

    def __init__(self, path: str):
        self.own = _tokenizer(path)

    def counts(self, text: str) -> int:
        """Tokens of a text, stretch by stretch: their counts add up, since no token lies across a stable place."""
        words = STRETCH.findall(text)
        if new := [w for w in {*words} if w not in self]:
            if len(self) + len(new) > WORDS:
                self.clear()
                new = list({*words})
            self.update(zip(new, map(len, self.own.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        out = sum(map(self.__getitem__, words))
        for w in new:
            if len(w) > LONGEST:
                del self[w]
        return out


@lru_cache(maxsize=2)
def _known(path: str) -> _Words:
    """One memory for all tasks of a worker process."""
    return _Words(path)


def _plain(path: str) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, n_bytes, text) -> (id, n_bytes, n_tokens)."""
        known = _known(path)
        for b in batches:
            n = [known.counts(t.as_py() or "") for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    return count


def _cut(overlap: int) -> Callable:
    """(key, text, units) -> (key, lo, hi, k, at, last, part): chunks of the units, the whole unit if overlap is 0."""
    shape = pa.schema([("key", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("k", pa.int32()), ("at", pa.int64()), ("last", pa.bool_()), ("part", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text, units in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                whole = text.as_py()
                for u in units or [{"lo": 0, "hi": None}]:
                    lo, hi = u["lo"], len(whole) if u["hi"] is None else u["hi"]
                    starts = range(lo, max(hi - CHUNK // 2, lo + 1), CHUNK) if overlap else [lo]
                    for k, at in enumerate(starts):
                        last = k == len(starts) - 1
                        row = (key, lo, hi, k, at, last, whole[at : hi if last else min(hi, at + CHUNK + overlap)])
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, shape.types, strict=True)], schema=shape)

    return cut


def boundaries(text: str, starts: np.ndarray, ends: np.ndarray, lo: int, hi: int) -> list[tuple[int, int]]:
    """(place, tokens before it) of the stable places of text[lo:hi] that no token lies across."""
    out = []
    for m in STABLE.finditer(text, lo, hi):
        if (p := m.start()) > lo:  # at lo itself one chunk does not see what stands before
            i = int(np.searchsorted(starts, p))
            if not i or ends[i - 1] <= p:
                out.append((p, i))
    return out


def _encode(path: str, overlap: int) -> Callable:
    """(key, lo, hi, k, at, last, part) -> tokens and the boundaries in the overlaps before and behind."""
    place = pa.list_(pa.struct([("p", pa.int64()), ("i", pa.int64())]))
    shape = pa.schema([("key", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("k", pa.int32()), ("last", pa.bool_()), ("n", pa.int64()), ("head", place), ("tail", place)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizer(path)
        for b in batches:
            for key, lo, hi, k, at, last, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got = own.encode(part, add_special_tokens=False)
                head, tail = [], []
                if overlap:
                    starts, ends = np.array(got.offsets, np.int64).reshape(-1, 2).T
                    if k:
                        head = boundaries(part, starts, ends, 0, min(overlap, len(part)))
                    if not last:
                        tail = boundaries(part, starts, ends, CHUNK, min(CHUNK + overlap, len(part)))
                row = (key, lo, hi, k, last, len(got), *([{"p": at + p, "i": i} for p, i in x] for x in (head, tail)))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, shape.types, strict=True)], schema=shape)

    return encode


def _spliced(chunks: DataFrame) -> DataFrame:
    """(key, p, to, n): stretches between splices; n is null where chunks did not come together.

    Two chunks come together if the stable places of their overlap are the same in both, there is one, and both have
    the same number of tokens between any two of them. The first of them is the splice.
    """
    counted = lambda c: F.transform(c, lambda x: x["i"] - c[0]["i"])
    places = lambda c: F.transform(c, lambda x: x["p"])
    left = chunks.filter("not last").select("key", "lo", "hi", "k", "tail")
    right = chunks.filter("k > 0").select("key", "lo", (F.col("k") - 1).alias("k"), "head")
    met = left.join(right, ["key", "lo", "k"]).filter((F.size("tail") > 0) & (places(F.col("tail")) == places(F.col("head"))))
    met = met.filter(counted(F.col("tail")) == counted(F.col("head")))
    joints = met.select("key", "lo", "k", F.col("tail")[0]["p"].alias("p"), F.col("tail")[0]["i"].alias("ends"), F.col("head")[0]["i"].alias("starts"))
    begin = chunks.filter("k = 0").select("key", "lo", F.lit(-1).alias("k"), F.col("lo").alias("p"), F.lit(0).cast("long").alias("ends"), F.lit(0).cast("long").alias("starts"))
    end = chunks.filter("last").select("key", "lo", "k", F.col("hi").alias("p"), F.col("n").alias("ends"), F.lit(0).cast("long").alias("starts"))
    w = Window.partitionBy("key", "lo").orderBy("k")
    out = joints.unionByName(begin).unionByName(end)
    out = out.select("key", "k", F.col("p").alias("to"), "ends", F.lag("k").over(w).alias("was"), F.lag("p").over(w).alias("p"), F.lag("starts").over(w).alias("before"))
    return out.filter("was is not null").select("key", "p", "to", F.when(F.col("k") - F.col("was") == 1, F.col("ends") - F.col("before")).alias("n"))


def _huge_counts(texts: DataFrame, path: str) -> DataFrame:
    """(key, text) with equal texts under equal keys -> (key, n_tokens), written."""
    units, sums = None, []
    for overlap in (*OVERLAPS, 0):
        work = texts.withColumn("units", F.lit(None).cast("array<struct<lo:long,hi:long>>")) if units is None else texts.join(units, "key")
        chunks = work.select("key", "text", "units").mapInArrow(_cut(overlap), "key string, lo long, hi long, k int, at long, last boolean, part string")
        # copies of a text have the same chunks: one of each is encoded, wherever the exchange puts it
        chunks = chunks.dropDuplicates(["key", "lo", "k"]).select("key", "lo", "hi", "k", "at", "last", "part")
        place = "array<struct<p:long,i:long>>"
        done = saved(chunks.mapInArrow(_encode(path, overlap), f"key string, lo long, hi long, k int, last boolean, n long, head {place}, tail {place}"), "chunk-tokens")
        part = saved(_spliced(done) if overlap else done.select("key", F.col("lo").alias("p"), F.col("hi").alias("to"), "n"), "spliced")
        dropped(done)
        sums.append(part)
        still = part.filter("n is null")
        if not overlap or still.isEmpty():
            break
        units = still.groupBy("key").agg(F.collect_list(F.struct(F.col("p").alias("lo"), F.col("to").alias("hi"))).alias("units"))
    out = sums[0]
    for s in sums[1:]:
        out = out.unionByName(s)
    out = saved(out.groupBy("key").agg(F.sum("n").alias("n_tokens")), "token-counts")
    dropped(*sums)
    return out


def token_counts(docs: DataFrame, id_col: str, text_col: str, path: str, limit: int = 2048) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row, as the library counts a whole text's tokens.

    ``path``: a tokenizer's .json file that executors can read too. Texts of more than HUGE bytes are cut into chunks
    that overlap and are dealt over all tasks; each chunk is encoded with offsets, and neighbours are spliced at the
    first stable place of their overlap at which both break. Stable are places before a blank behind anything else:
    no token of a vocabulary whose words end at white space or begin with one blank lies across them, no pattern looks
    behind, white space is a starter for every normal form, and no special string holds any. Where an overlap has no
    such place or the chunks differ in it, the stretch between the splices around is encoded again with a wider
    overlap, at last in one piece (a word of that length cannot be encoded in parts). Other texts are counted by
    stretches between such places, which a worker process remembers.

    A null text is empty; an empty one has no tokens. Special strings in texts count as the library's default has it.
    Repeated rows, equal and null ids are rows of their own; an empty table gives no rows.
    """
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.filter(F.col("n_bytes") <= HUGE).mapInArrow(_plain(path), f"id {kind}, n_bytes long, n_tokens long")
    huge = rows.filter(F.col("n_bytes") > HUGE).withColumn("key", F.sha2("text", 256))
    if not huge.isEmpty():
        counts = _huge_counts(huge.select("key", "text"), path)
        met = huge.select("id", "n_bytes", "key").join(small(counts, counts.count(), FEW), "key")
        out = out.unionByName(met.select("id", "n_bytes", "n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("id", id_col)


def op13_overlap_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"))
