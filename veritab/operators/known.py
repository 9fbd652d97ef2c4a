"""Known values in whole texts, all at once, with places in the original; then detectors in their order of priority."""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.sources.stage import dropped, saved

#: Characters that part words besides white space.
BLANKS = "_"
#: Known values, and their characters, up to which one table goes to all tasks: some 30 bytes a value and one to four a character.
MOST, MOST_CHARS = 4_000_000, 64_000_000
#: Characters of the beginning by which values and texts meet beyond that.
GRAM = 12
#: Bits (a power of two) that tell which beginnings no value has: 16 MB, whatever the number of values.
BITS = 1 << 27
#: Known values shorter than this are not looked for.
LEAST = 4
#: Characters up to which all ends of a value are tried at each beginning; longer values must first begin alike. Beginnings that are tried at a time.
NEAR, AT_A_TIME = 64, 1 << 14
SPANS = "start int, stop int, kind string, source string, said string"

_WIDE = np.zeros(0x110000, np.uint8)  # code points of a character's fold; 0: not looked up yet
_FIRST = np.zeros(0x110000, np.uint32)
_BLANK = np.zeros(0x110000, bool)
_REST: dict[int, str] = {}


def _learn(codes: np.ndarray) -> None:
    for code in np.unique(codes[_WIDE[codes] == 0]).tolist():
        c = chr(code)
        if c in BLANKS or c.isspace():
            out, _BLANK[code] = " ", True
        else:
            out = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).casefold() or c
        _WIDE[code], _FIRST[code], _REST[code] = len(out), ord(out[0]), out


def fold_map(text: str) -> tuple[str, np.ndarray]:
    """(folded text, place in ``text`` of each of its characters, and the length of ``text`` behind them).

    Each character alone: NFKD without combining marks, casefolded (itself if nothing is left); runs of white space
    and underscores are one blank.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    _learn(codes)
    wide, at = _WIDE[codes], np.arange(len(codes))
    if (wide > 1).any():
        at = np.repeat(at, wide)
        out = _FIRST[codes[at]]
        for i in np.flatnonzero(np.diff(at, prepend=-1) == 0).tolist():
            begin = i
            while at[begin - 1] == at[i]:
                begin -= 1
            out[i] = ord(_REST[int(codes[at[i]])][i - begin])
    else:
        out = _FIRST[codes]
    blank = _BLANK[codes][at]
    keep = ~(blank & np.concatenate([[False], blank[:-1]])) if len(blank) else blank
    return out[keep].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), np.append(at[keep], len(codes))


def folded(text: str) -> str:
    return fold_map(text)[0].strip()


def folded_all(texts: list[str]) -> list[str]:
    """:func:`folded` of each text, all in one pass: a NUL parts them and is no blank."""
    out = fold_map("\0".join(texts))[0].split("\0") if texts else []
    return [x.strip() for x in out] if len(out) == len(texts) else [folded(x) for x in texts]


_WORD = frozenset("0123456789abcdefghijklmnopqrstuvwxyz")
_IS_WORD = np.array([chr(c) in _WORD for c in range(128)])


def automaton(values: Iterable[tuple[str, str]]):
    """One automaton of (folded value, kind); None if there are none."""
    out = ahocorasick.Automaton()
    for value, kind in values:
        out.add_word(value, (len(value), kind))
    out.make_automaton()
    return out if len(out) else None


_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first ``n`` powers, and more, of the base of hashes and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(2 * n, base, np.uint64)
            x[0] = 1
            _POWERS[i] = np.cumprod(x)
    return _POWERS


class Table:
    """Folded values by a rolling hash: a text is searched at the beginnings of its words only, all of them at a time.

    A bit tells of most hashes that no value has them; the others are looked up, and the characters compared.
    """

    def __init__(self, values: list[str], kinds: list[str]):
        self.names = sorted(set(kinds))
        code = {k: i for i, k in enumerate(self.names)}
        size = np.fromiter(map(len, values), np.int64, len(values))
        hashes = np.zeros(len(values), np.uint64)
        heads = [v[:NEAR] for v in values if len(v) > NEAR]
        for i in range(0, len(values), 1 << 16):
            stop = np.cumsum(size[i : i + (1 << 16)])
            hashes[i : i + (1 << 16)] = self._hash(self._sums("".join(values[i : i + (1 << 16)])), stop - size[i : i + (1 << 16)], stop)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.size, self.text = hashes[order], size[order].astype(np.int32), "".join(values[i] for i in order.tolist())
        self.at = np.cumsum(self.size, dtype=np.int64) - self.size
        self.kind = np.fromiter((code[kinds[i]] for i in order.tolist()), np.int32, len(order))
        self.bits = self._bits(hashes)
        self.heads = self._bits(np.concatenate([self._hash(self._sums(h), np.zeros(1, np.int64), np.array([NEAR])) for h in set(heads)])) if heads else None
        lengths = np.unique(size)
        self.far, lengths = lengths[lengths > NEAR], lengths[lengths <= NEAR]
        self.near = np.isin(np.arange(NEAR + 1), lengths)
        self.least, self.most = (int(lengths[0]), int(lengths[-1])) if len(lengths) else (1, 0)

    @staticmethod
    def _sums(low: str) -> np.ndarray:
        codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * _MIX * _powers(len(codes) + 1)[0][: len(codes)])])

    @staticmethod
    def _hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        h = (sums[stop] - sums[start]) * _powers(len(sums))[1][start]
        return (h ^ (h >> np.uint64(32))) * _MIX

    @staticmethod
    def _bits(hashes: np.ndarray) -> tuple[np.ndarray, np.uint64]:
        """64 bits a value at least; a hash's first bits tell its place."""
        wide = max(16, (64 * len(hashes)).bit_length())
        out, h = np.zeros(1 << wide - 3, np.uint8), hashes >> np.uint64(64 - wide)
        np.bitwise_or.at(out, (h >> np.uint64(3)).astype(np.int64), np.uint8(1) << (h & np.uint64(7)).astype(np.uint8))
        return out, np.uint64(64 - wide)

    @staticmethod
    def _held(bits: tuple[np.ndarray, np.uint64], hashes: np.ndarray) -> np.ndarray:
        h = hashes >> bits[1]
        return (bits[0][(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8) & np.uint8(1)).view(bool)

    def _pairs(self, sums: np.ndarray, starts: np.ndarray, stops: np.ndarray, is_stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(starts, stops) of what is as long as some value."""
        for i in range(0, len(starts) if self.most else 0, AT_A_TIME):
            some = starts[i : i + AT_A_TIME]
            first, last = np.searchsorted(stops, some + self.least), np.searchsorted(stops, some + self.most, "right")
            n = last - first
            a = np.repeat(some, n)
            b = stops[np.arange(len(a)) + np.repeat(first - (np.cumsum(n) - n), n)]
            fits = self.near[b - a]
            yield a[fits], b[fits]
        if self.heads is not None:
            starts = starts[starts + NEAR < len(sums)]
            starts = starts[self._held(self.heads, self._hash(sums, starts, starts + NEAR))]
            for n in self.far.tolist():
                a = starts[: np.searchsorted(starts, len(sums) - n)]
                a = a[is_stop[a + n]]
                yield a, a + n

    def hits(self, low: str) -> Iterator[tuple[int, int, str]]:
        """(begin, minus length, kind) of every value between other characters than those of words."""
        codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
        word, blank, edge = _IS_WORD[np.minimum(codes, 127)], codes == 32, np.zeros(1, bool)
        is_stop = np.concatenate([edge, ~blank]) & ~np.concatenate([word, edge])  # no value begins or ends with a blank
        sums, starts = self._sums(low), np.flatnonzero(~np.concatenate([edge, word[:-1]]) & ~blank) if len(codes) else np.zeros(0, np.int64)
        for a, b in self._pairs(sums, starts, np.flatnonzero(is_stop), is_stop):
            h = self._hash(sums, a, b)
            held = np.flatnonzero(self._held(self.bits, h))
            a, b, h = a[held], b[held], h[held]
            at = np.searchsorted(self.hashes, h)
            met = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] == h)
            for begin, stop, i, x in zip(a[met].tolist(), b[met].tolist(), at[met].tolist(), h[met], strict=True):
                while i < len(self.hashes) and self.hashes[i] == x:  # other values may have the same hash
                    if self.size[i] == stop - begin and self.text.startswith(low[begin:stop], int(self.at[i])):
                        yield begin, begin - stop, self.names[self.kind[i]]
                    i += 1


def _automaton_hits(low: str, known) -> Iterator[tuple[int, int, str]]:
    for last, (n, kind) in known.iter(low):
        begin = last - n + 1
        if not (begin and low[begin - 1] in _WORD or last + 1 < len(low) and low[last + 1] in _WORD):
            yield begin, -n, kind


def known_places(text: str, known) -> list[tuple[int, int, str]]:
    """(start, stop, kind) of known values, a :class:`Table` or an automaton, as places in ``text``: whole words, from left to right the longest at each place."""
    low, at = fold_map(text)
    hits = known.hits(low) if isinstance(known, Table) else _automaton_hits(low, known)
    out, free = [], 0
    for begin, n, kind in sorted(hits):
        start, stop = int(at[begin]), int(at[begin - n - 1]) + 1
        if start >= free:
            out.append((start, stop, kind))
            free = stop
    return out


def places(text: str, known, detectors: list[tuple[str, re.Pattern]], kept: frozenset[str] = frozenset(), allowed: frozenset[tuple[str, str]] = frozenset()) -> list[tuple[int, int, str, str, str]]:
    """(start, stop, kind, source, said) of known values and then of what detectors find where nothing was found before.

    Detections of earlier detectors win; those of ``kept`` kinds hold their place but are not told, those that are
    ``allowed`` (kind, folded text) neither.
    """
    out = [(a, b, k, "known", text[a:b]) for a, b, k in known_places(text, known)] if known is not None else []
    taken = [x[:2] for x in out]
    for kind, pattern in detectors:
        new = []
        for m in pattern.finditer(text):
            a, b = m.span()
            i = bisect_left(taken, (a, a))
            if a < b and not (i < len(taken) and taken[i][0] < b) and not (i and taken[i - 1][1] > a):
                new.append((a, b))
                if kind not in kept and (kind, folded(text[a:b])) not in allowed:
                    out.append((a, b, kind, "pattern", text[a:b]))
        taken = sorted(taken + new)
    return sorted(out)


def _told(b: pa.RecordBatch, names: list[str], each: list[list[tuple]]) -> pa.RecordBatch:
    rows = pa.array(np.repeat(np.arange(b.num_rows), [len(x) for x in each]), pa.int64())
    cols = list(zip(*[y for x in each for y in x], strict=True)) or [()] * 5
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([b.column(i).take(rows) for i in range(len(names))] + [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[*names, "start", "stop", "kind", "source", "said"])


def _folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(folded_all(b.column(1).to_pylist()), pa.string())], names=["kind", "value"])


def _bits(grams: DataFrame) -> bytes:
    """BITS bits, set where the CRC-32 of a gram falls; put together by Spark, so that at most BITS / 64 numbers come to the driver."""
    at = grams.select((F.crc32(F.col("gram").cast("binary")) % BITS).alias("at"))
    words = at.groupBy(F.floor(F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("set")).toArrow()
    out = np.zeros(BITS // 64, "<i8")
    out[words["word"].to_numpy()] = words["set"].to_numpy()
    return out.tobytes()


def _grams(lengths: list[int], bits: Broadcast) -> Callable:
    """(key, text) -> (key, gram): what stands at the beginnings of words, once for each text, where a value may begin so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = bits.value
        for b in batches:
            for key, text in zip(b.column(0), b.column(1), strict=True):
                low = fold_map(text.as_py())[0]
                starts = [i for i in range(len(low)) if not i or low[i - 1] not in _WORD]
                at = {g: zlib.crc32(g.encode()) % BITS for g in {low[i : i + n] for i in starts for n in lengths}}
                found = [g for g, h in at.items() if some[h >> 3] >> (h & 7) & 1]
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(found), pa.string()), pa.array(found, pa.string())], names=["key", "gram"])

    return run


def personal_spans(docs: DataFrame, id_col: str, text_col: str, values: DataFrame, detectors: dict[str, str], kept: Iterable[str] = (), allowed: Iterable[tuple[str, str]] = (), most: int = MOST) -> DataFrame:
    """(id, start, stop, kind, source, said): places, in code points of the original, of personal data in each text.

    ``values`` (kind, value) are looked for all at once, whatever accents, case and blanks: folded texts are searched
    by one table, built once and sent to all tasks while there are at most ``most`` values (counted, like their
    characters). Beyond that texts and values meet by what stands at the beginnings of words, and each text runs
    through an automaton of the values it met; both ways give the same rows. A known value stands between other
    characters than a-z and 0-9; from left to right the longest at each place is taken. Then ``detectors`` (kind ->
    pattern) search the original in their order; what overlaps something found before is left out. ``kept`` kinds hold
    their place but are not told; ``allowed`` (kind, text) are not told either.

    A value of several kinds counts as the first of them by name; values shorter than LEAST when folded, and nulls,
    are left out. A null or empty text has no rows; rows with a null id and repeated rows are told as they are.
    """
    id_kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("text <> ''")
    low = values.select(F.col("kind").cast("string").alias("kind"), F.col("value").cast("string").alias("value")).filter("kind is not null and value is not null")
    low = saved(low.distinct().mapInArrow(_folds, "kind string, value string").filter(F.length("value") >= LEAST).groupBy("value").agg(F.min("kind").alias("kind")), "known-values")
    size = low.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).alias("chars")).first()
    search = [(k, re.compile(p)) for k, p in detectors.items()]
    kept, allowed = frozenset(kept), frozenset((k, folded(v)) for k, v in allowed)
    if size["n"] <= most and (size["chars"] or 0) <= MOST_CHARS:
        all_of = low.toArrow()
        whole = rows.sparkSession.sparkContext.broadcast(Table(all_of["value"].to_pylist(), all_of["kind"].to_pylist()))
        dropped(low)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield _told(b, ["id"], [places(t.as_py(), whole.value, search, kept, allowed) for t in b.column(1)])

        return rows.mapInArrow(run, f"id {id_kind}, {SPANS}").withColumnRenamed("id", id_col)
    keyed = rows.withColumn("key", F.sha2("text", 256))
    gram = low.withColumn("gram", F.substring("value", 1, GRAM))
    lengths = sorted(r[0] for r in gram.select(F.length("gram")).distinct().collect())  # GRAM at most
    met = keyed.select("key", "text").mapInArrow(_grams(lengths, rows.sparkSession.sparkContext.broadcast(_bits(gram))), "key string, gram string").distinct().join(gram, "gram")
    met = saved(met.groupBy("key").agg(F.collect_list(F.struct("value", "kind")).alias("own")), "met-values")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [places(t.as_py(), automaton((v["value"], v["kind"]) for v in x or ()), search, kept, allowed) for t, x in zip(b.column(1), b.column(2).to_pylist(), strict=True)]
            yield _told(b, ["id"], each)

    return keyed.join(met, "key", "left").select("id", "text", "own").mapInArrow(own, f"id {id_kind}, {SPANS}").withColumnRenamed("id", id_col)
