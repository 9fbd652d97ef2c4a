"""Phrase collocations by hierarchical pair naming: a phrase is the pair of its first and its last words but one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.llm.common import dropped, saved, table

#: Bytes of text that a task reads into one block.
BLOCK = 16 << 20
#: A name in a block is its block's number and its own, of LID bits; a task numbers its blocks by BLOCKS bits.
LID, BLOCKS = 28, 14
#: Parts over which the phrases of a language are dealt before the best of each part meet.
PARTS = 32
#: A-Z are lowered, tabs are spaces, and whatever ends a piece is a line end.
FLAT = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
_BLOCK = {"block": pa.int64(), "lang": pa.string(), "seq": pa.binary(), "uid": pa.int64()}
_WORDS = pa.schema(_BLOCK | {"word": pa.string(), "n": pa.int64()})
_PAIRS = pa.schema(_BLOCK | {"first": pa.int64(), "rest": pa.int64(), "n": pa.int64()})


class _Names(dict):
    """Words to numbers as they come: 0 ends a piece, 1 is no word."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        return out


def _packed(seq: np.ndarray) -> bytes:
    return zstandard.compress(seq.tobytes(), 1)


def _rows(shape: pa.Schema, block: int, lang: str, seq: np.ndarray, lids: np.ndarray, *rest: pa.Array) -> Iterator[pa.RecordBatch]:
    """The row that holds a block's sequence, then its dictionary."""
    n = len(lids)
    if n and int(lids[-1]) >= 1 << LID:
        raise OverflowError(f"a block of more than {1 << LID} names")
    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((block, lang, _packed(seq)), shape.types[:3], strict=True)] + [pa.nulls(1, t) for t in shape.types[3:]], schema=shape)
    yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array([lang] * n if shape is _WORDS else [None] * n, pa.string()), pa.nulls(n, pa.binary()), pa.array((block << LID) + lids.astype(np.int64)), *rest], schema=shape)


def _stretches(flat: bytes) -> Iterator[bytes]:
    """A text, cut at ends of pieces into stretches of about BLOCK bytes: no phrase crosses the end of a piece."""
    at = 0
    while at < len(flat):
        end = flat.find(b"\n", at + BLOCK)
        end = len(flat) if end < 0 else end
        yield flat[at:end]
        at = end


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> blocks of numbered words, one for each language of some BLOCK bytes of text."""
    number, size, blocks = TaskContext.get().partitionId() << BLOCKS, 0, {}

    def emptied() -> Iterator[pa.RecordBatch]:
        nonlocal number, size
        for lang, (names, seqs) in blocks.items():
            seq, words = np.concatenate(seqs), [w.decode() for w in list(names)[2:]]
            yield from _rows(_WORDS, number, lang, seq, np.arange(2, len(names)), pa.array(words, pa.string()), pa.array(np.bincount(seq, minlength=len(names))[2:], pa.int64()))
            number += 1
            if not number % (1 << BLOCKS):
                raise OverflowError(f"more than {1 << BLOCKS} blocks in a task")
        size = 0
        blocks.clear()

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            for flat in _stretches((text.as_py() or "").encode().translate(FLAT)):
                names, seqs = blocks.setdefault(lang, (_Names(), []))
                words = flat.replace(b"\n", b" \n ").split(b" ")
                ids = np.fromiter(map(names.__getitem__, words), np.int32, len(words))
                seqs += [ids[ids != 1], np.zeros(1, np.int32)]
                size += len(flat)
                if size >= BLOCK:
                    yield from emptied()
    yield from emptied()


def _paired(last: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """(sequence of a block, its frequent names) -> pairs of names that stand side by side, numbered and counted.

    The new sequence has at each place the pair that begins there, 0 where there is none; ``last`` leaves it out.
    """

    def pairs(block: pa.Table, names: pa.Table) -> pa.Table:
        out = []
        for row in block.to_pylist():
            seq = np.frombuffer(zstandard.decompress(row["seq"]), np.int32)
            lids = names.column("uid").to_numpy() & ((1 << LID) - 1)
            ids = np.full(max(int(seq.max(initial=0)), int(lids.max(initial=0))) + 1, -1)
            ids[lids] = names.column("id").to_numpy()
            good = ids[seq] >= 0
            both = good[:-1] & good[1:]
            wide = len(ids)
            found, own, n = np.unique(seq[:-1][both] * np.int64(wide) + seq[1:][both], return_inverse=True, return_counts=True)
            after = np.zeros(0 if last else max(0, len(seq) - 1), np.int32)
            if not last and len(after):
                after[both] = own + 1
            out += _rows(_PAIRS, row["block"], row["lang"], after, np.arange(1, len(found) + 1), pa.array(ids[found // wide]), pa.array(ids[found % wide]), pa.array(n, pa.int64()))
        return pa.Table.from_batches(out, _PAIRS)

    return pairs


def _named(own: DataFrame, key: list[str], least: int) -> DataFrame:
    """(uid, key, f, id) of names that occur ``least`` times over all blocks; ``id`` is the least uid of a name.

    One exchange both counts a name and hands its global id to each block that has it: a name has one row a block.
    """
    w = Window.partitionBy(*key)
    out = own.withColumns({"f": F.sum("n").over(w), "id": F.min("uid").over(w)}).drop("n")
    return saved(out.filter(F.col("f") >= least), "names")


def _levels(docs: DataFrame, least: int, longest: int) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n), and for each length (lang, id, first, rest, phrase, word, f, pre, suf) of the frequent phrases.

    ``first`` and ``rest`` name the phrase without its last and without its first word; ``pre[i]`` is how often its
    first i + 1 words occur, ``suf[i]`` how often what follows them does.
    """
    rows = saved(docs.mapInArrow(_words, "block long, lang string, seq binary, uid long, word string, n long"), "word-blocks")
    own = rows.filter("seq is null")
    totals = saved(own.groupBy("lang").agg(F.sum("n").alias("n")), "word-totals")
    none = F.lit(None).cast("long")
    counts = F.array().cast("array<long>")
    names = _named(own.select("uid", "lang", "word", "n"), ["lang", "word"], least)
    level = saved(names.filter("uid = id").select("lang", "id", none.alias("first"), none.alias("rest"), F.col("word").alias("phrase"), "word", "f", counts.alias("pre"), counts.alias("suf")), "phrases")
    out = [level]
    for k in range(2, longest + 1):
        seqs = rows.filter("seq is not null").select("block", "lang", "seq")
        mine = names.select(F.shiftright("uid", LID).alias("home"), "uid", "id")
        pairs = seqs.groupBy("block").cogroup(mine.groupBy("home")).applyInArrow(_paired(k == longest), "block long, lang string, seq binary, uid long, first long, rest long, n long")
        if k < longest:
            before, rows = [rows, names], saved(pairs, "pair-blocks")
            names = _named(rows.filter("seq is null").select("uid", "first", "rest", "n"), ["first", "rest"], least)
            dropped(*before)
            known = names.filter("uid = id").select("id", "first", "rest", "f")
        else:  # nobody needs the last names in their places
            known = pairs.filter("seq is null").groupBy("first", "rest").agg(F.sum("n").alias("f"), F.min("uid").alias("id")).filter(F.col("f") >= least)
        a = level.select("lang", F.col("id").alias("first"), F.col("phrase").alias("p"), F.concat("pre", F.array("f")).alias("pre"))
        z = level.select(F.col("id").alias("rest"), "word", F.concat(F.array("f"), "suf").alias("suf"))
        met = known.join(a, "first").join(z, "rest")
        level = saved(met.select("lang", "id", "first", "rest", F.concat_ws(" ", "p", "word").alias("phrase"), "word", "f", "pre", "suf"), "phrases")
        out.append(level)
    dropped(rows, names)
    return totals, out


#: The lowest-scoring cut; products are decimals of 38 digits.
CUT = """array_min(transform(arrays_zip(pre, suf), (x, i) -> struct(
    (cast(1000000 as decimal(7,0)) * (cast(f as decimal(19,0)) * cast(f as decimal(19,0)))) div (cast(x.pre as decimal(19,0)) * cast(x.suf as decimal(19,0))) as score,
    i as cut, x.pre as l, x.suf as r)))"""


def collocations(docs: DataFrame, lang_col: str, text_col: str, longest: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases of 2 to ``longest`` words.

    A-Z are lowered; ``.,;:!?`` and U+000A to U+000D end a piece, blanks and tabs part its words. Words that occur
    ``least`` times are named; adjacent names of k - 1 words that are frequent make a pair, and pairs that are
    frequent over all blocks get a name of their own by a global join, up to ``longest`` words. A pair's two parts are
    pointers to its parents: counts of all beginnings and ends come along them for the cuts, and counts of longer
    phrases go back along them: a phrase is left out if a longer one around it has ``share`` percent of its count.

    A phrase of a occurrences, cut into parts of l and r, scores floor(1000000 a a / (l r)); its lowest cut counts
    (ties: the shortest first part). The ``top`` phrases of each language are ranked by score, a, and phrase in byte
    order. Counts are exact while they stay below 10**16.

    A null language is ``und``, a null text is empty; repeated rows count each time. A very long text is cut at ends
    of pieces; a piece of any length is held whole. An empty table gives no rows; other columns are not read.
    """
    slim = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    totals, levels = _levels(slim, least, longest)
    above, kept = None, []
    for level in reversed(levels[1:]):
        level = level.withColumn("around", F.lit(0).cast("long")) if above is None else level.join(above, "id", "left").withColumn("around", F.coalesce("around", F.lit(0).cast("long")))
        kept.append(level.filter(F.col("around") * 100 < F.col("f") * share).select("lang", "phrase", F.col("f").alias("a"), F.expr(CUT).alias("c")))
        most = F.greatest("f", "around").alias("around")
        above = level.select(F.col("first").alias("id"), most).unionByName(level.select(F.col("rest").alias("id"), most)).groupBy("id").agg(F.max("around").alias("around"))
    if not kept:
        raise ValueError("longest is 2 at least")
    rows = kept[0]
    for k in kept[1:]:
        rows = rows.unionByName(k)
    rows = rows.select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*best))).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    return rows.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_pair_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), "lang", "text")


OP11_SQL = r"""
with pieces as (select row_number() over () as p, lang, piece from (
        select coalesce(lang, 'und') as lang,
            unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
        from documents)),
words as (select lang, p, unnest(w) as w1, unnest(range(len(w))) as i from (select lang, p, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces)),
runs as (select lang, w1, lead(w1) over q as w2, lead(w1, 2) over q as w3 from words window q as (partition by p order by i)),
n as (select lang, count(*) as n from words group by lang),
f1 as (select lang, w1, count(*) as f from runs group by all),
f2 as (select lang, w1, w2, count(*) as f from runs where w2 is not null group by all),
f3 as (select lang, w1, w2, w3, count(*) as f from runs where w3 is not null group by all having count(*) >= 10),
two as (select f2.lang, f2.w1 || ' ' || f2.w2 as phrase, f2.f as a, x.f as l, y.f as r, (1000000::hugeint * f2.f * f2.f) // (x.f::hugeint * y.f) as score
    from f2 join f1 x on x.lang = f2.lang and x.w1 = f2.w1 join f1 y on y.lang = f2.lang and y.w1 = f2.w2
    where f2.f >= 10
        and not exists (select 1 from f3 t where t.lang = f2.lang and t.w1 = f2.w1 and t.w2 = f2.w2 and 100 * t.f >= 50 * f2.f)
        and not exists (select 1 from f3 t where t.lang = f2.lang and t.w2 = f2.w1 and t.w3 = f2.w2 and 100 * t.f >= 50 * f2.f)),
cuts as (select t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 as phrase, t.f as a, 1 as cut, x.f as l, y.f as r
    from f3 t join f1 x on x.lang = t.lang and x.w1 = t.w1 join f2 y on y.lang = t.lang and y.w1 = t.w2 and y.w2 = t.w3
    union all
    select t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 2, x.f, y.f
    from f3 t join f2 x on x.lang = t.lang and x.w1 = t.w1 and x.w2 = t.w2 join f1 y on y.lang = t.lang and y.w1 = t.w3),
three as (select lang, phrase, a, l, r, score from (select *, (1000000::hugeint * a * a) // (l::hugeint * r) as score from cuts)
    qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from (select * from two union all select * from three))
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from ranked join n using (lang) where rank <= 2000
"""
