"""Toxicity: noisy-channel deobfuscation of words, then scores of the restored text learnt from labels."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm.common import dropped, saved, small, table

#: What an observed character may stand for beside itself.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Characters that may stand for nothing inside a word.
FILLERS = " .-_*~'`,:;/\\^"
#: Costs, in nats, of a substitution, a filler, a dropped repetition, and a character kept that is no letter.
SWAP, SKIP, AGAIN, STRANGE = 0.7, 0.3, 0.3, 7.0
#: Readings of a word that are scored.
READINGS = 4
#: Labelled rows from which the classifier is fitted at most, lowest by hash of the id.
FIT_ROWS = 20_000
#: Score from which a word is sure.
SURE = 0.7
PREFIXES = (4, 5, 6, 7)
LETTER = re.compile(r"[^\W\d_]")
#: A word with a letter is decoded if it has one of these; each is found in time linear in the word.
ODD = re.compile(r"(?<=.)[0-9@$!|+(€£.\-_*~'`:/\\^,;\s](?=.)|[0-9@$!|+(€£][^\W\d_]|[^\W\d_][0-9@$!|]|(.)\1", re.S)
#: Three or more single characters with one or two blanks of any kind between them, and marks after the last.
SPACED = re.compile(r"(?<!\S)[\w@$|!+(€£*](?:\s{1,2}[\w@$|!+(€£*]){2,}(?=[.,;:!?\"')\]]*(?:\s|$))")
STRIP = ".,;:!?\"'()[]{}<>*&%#$+=~`|/\\-_"
SYMBOLS = 28  # boundary, a to z, any other letter


def _code(c: str) -> int:
    o = ord(c) - 96
    return o if 1 <= o <= 26 else 27 if c.isalpha() else 0


_CODES = np.array([_code(chr(i)) if i < 128 else 27 for i in range(256)], dtype=np.int64)


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, dtype=np.int64)
    for b in batches:
        for t in b.column(0):
            raw = np.frombuffer((t.as_py() or "").lower().encode(), dtype=np.uint8)
            for at in range(0, max(1, len(raw) - 2), 1 << 20):
                x = _CODES[raw[at : at + (1 << 20) + 2]]
                x = np.concatenate([[0] * (at == 0), x, [0] * (at + (1 << 20) + 2 >= len(raw))]).astype(np.int64)
                if len(x) > 2:
                    total += np.bincount(x[:-2] * SYMBOLS**2 + x[1:-1] * SYMBOLS + x[2:], minlength=SYMBOLS**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])


def character_model(texts: DataFrame) -> list[float]:
    """Log-probabilities of a character after two others, from the trigrams of all texts (28**3 cells at most)."""
    n = np.full(SYMBOLS**3, 0.05)
    for r in texts.mapInArrow(_count_trigrams, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        n[r["cell"]] += r["n"]
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    return np.log(n / n.sum(axis=2, keepdims=True)).reshape(-1).tolist()


def decode(word: str, model: list[float], readings: int = READINGS) -> list[str]:
    """The likeliest readings of an obfuscated word, best first.

    The lattice has, for each character, itself, the letters that it may stand for, nothing if it is a filler, and
    nothing if it repeats the one before; fillers that are blanks may also end a word. The character model is the
    prior and the costs above are the channel. Viterbi: what follows depends on the last two symbols of the reading
    and its last character, so hypotheses that agree there meet, and each such state keeps its ``readings`` best
    different ones. No other path is discarded, and time and memory grow with the length of the word. Readings are
    linked backwards from character to character.
    """
    now: dict[tuple[int, int, str], list[tuple[float, int, tuple | None]]] = {(0, 0, ""): [(0.0, 0, None)]}
    before = ""
    for c in word:
        stands, filler, blank, options = _channel(c)
        if len(now) == 1 and len(options) == 1 and not filler:
            (((a, b, last), hyps),) = now.items()
            if c != before and last != c and last not in stands:  # one way on: nothing meets
                x, k, price = options[0]
                paid, o = price - model[(a * SYMBOLS + b) * SYMBOLS + k], ord(x) + 1
                now = {(b, k, x): [(cost + paid, (h * 1_000_003 + o) & _MASK, (x, node)) for cost, h, node in hyps]}
                before = c
                continue
        after: dict[tuple[int, int, str], list[tuple[float, int, tuple | None]]] = {}
        for (a, b, last), hyps in now.items():
            at = (a * SYMBOLS + b) * SYMBOLS
            if filler:
                after.setdefault((a, b, last), []).extend((cost + SKIP, h, node) for cost, h, node in hyps)
                if blank and b:
                    after.setdefault((b, 0, " "), []).extend((cost - model[at], _step(h, " "), (" ", node)) for cost, h, node in hyps)
            for x, k, price in options:
                paid = price - model[at + k]
                after.setdefault((b, k, x), []).extend((cost + paid, _step(h, x), (x, node)) for cost, h, node in hyps)
            if last and (c == before or last in stands or last == c):
                after.setdefault((a, b, last), []).extend((cost + AGAIN, h, node) for cost, h, node in hyps)
        now = {state: _best(hyps, readings) for state, hyps in after.items()} or now
        before = c
    ends = [(cost - model[(a * SYMBOLS + b) * SYMBOLS], h, node) for (a, b, _), hyps in now.items() for cost, h, node in hyps]
    return [_spelt(node) for _, _, node in _best(ends, readings)]


_MASK = 0xFFFFFFFFFFFFFFFF


@lru_cache(maxsize=10_000)
def _channel(c: str) -> tuple[str, bool, bool, list[tuple[str, int, float]]]:
    """What a character may stand for, whether it may be a filler or a blank, and the symbols it may be with their costs."""
    stands, blank = LEET.get(c, ""), c.isspace()
    filler = blank or c in FILLERS
    options = [(c, _code(c), 0.0)] if c.isalpha() else [] if filler else [(c, _code(c), STRANGE)]
    return stands, filler, blank, options + [(x, _code(x), SWAP) for x in stands]


def _step(h: int, x: str) -> int:
    """The hash of a reading that goes on by ``x``."""
    return (h * 1_000_003 + ord(x) + 1) & _MASK


def _best(hyps: list[tuple[float, int, tuple | None]], most: int) -> list[tuple[float, int, tuple | None]]:
    """The ``most`` cheapest hypotheses of different readings."""
    if len(hyps) == 1:
        return hyps
    out, seen = [], set()
    for hyp in sorted(hyps, key=lambda x: (x[0], x[1])):
        if hyp[1] not in seen:
            seen.add(hyp[1])
            out.append(hyp)
            if len(out) == most:
                break
    return out


def _spelt(node: tuple | None) -> str:
    out = []
    while node:
        out.append(node[0])
        node = node[1]
    return "".join(reversed(out))


def features(word: str, model: list[float]) -> frozenset[str]:
    """Features of one lower-case word: its restored readings and their beginnings."""
    bare = word.strip(STRIP)
    forms = {bare} if bare else set()
    core = word.strip("\"'.,;:?()[]{}<>&%#=")
    if core and LETTER.search(core) and ODD.search(core):
        for reading in decode(core, model):
            forms.update(reading.split())
    out = set()
    for f in forms:
        out.add(f)
        out.update(f"{f[:k]}~" for k in PREFIXES if len(f) >= k)
    return frozenset(out)


def words_of(text: str | None) -> set[str]:
    """Distinct lower-case words, and runs of single characters that may spell one."""
    t = (text or "").lower()
    return set(t.split()) | {m[0] for m in SPACED.finditer(t) if LETTER.search(m[0])}


def _learn(labelled: DataFrame, model: list[float], base: float, known: dict[str, float], whole: bool) -> dict[str, float]:
    """Scores of whole words, or of beginnings in the rows that no known word explains."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: tuple[Counter, Counter] = (Counter(), Counter())
            seen: dict[str, frozenset[str]] = {}
            for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                mine: set[str] = set()
                for w in words_of(t.as_py()):
                    if w not in seen:
                        seen[w] = features(w, model)
                    mine |= seen[w]
                if whole or not any(known.get(f, 0.0) >= SURE for f in mine):
                    n[int(y == 1)].update(f for f in mine if f.endswith("~") != whole)
            every = list(n[0].keys() | n[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *[pa.array([c[f] for f in every], pa.int64()) for c in n]], names=["feature", "clean", "toxic"])

    counts = labelled.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    counts = saved(counts, "toxic-features")
    n, rate = F.col("t") + F.col("c"), F.col("t") / (F.col("t") + F.col("c"))
    surprise = n * (rate * F.log(rate / base) + F.when(rate < 1, (1 - rate) * F.log((1 - rate) / (1 - base))).otherwise(0.0))
    sure = counts.filter((F.col("t") >= 3) & (rate > base)).filter(surprise >= math.log(max(1, counts.count())) + 2)
    got = sure.select("feature", ((F.col("t") + 2 * F.lit(base)) / (n + 2)).alias("p")).collect()  # bounded by FIT_ROWS
    dropped(counts)
    return {r["feature"]: r["p"] for r in got}


def fit(labelled: DataFrame, model: list[float]) -> tuple[float, dict[str, float]]:
    """(base rate, feature -> score) from rows (text, toxic).

    A feature's score is the share of toxic rows among the rows that have it, drawn to the base rate by two
    rows. A feature counts only if its share exceeds the base rate by more than chance explains among so many
    features (Chernoff bound). Whole words are learnt first; beginnings of words are learnt from the rows in
    which no sure word was found, so that they tell of unseen forms and not of the words known already. Rows
    are counted inside tasks and summed by feature.
    """
    labelled = saved(labelled.select("text", "toxic"), "toxic-rows")
    base, rows = labelled.agg(F.avg((F.col("toxic") == 1).cast("double")), F.count(F.lit(1))).first()
    if not rows or not 0 < base < 1:
        return base or 0.0, {}
    words = _learn(labelled, model, base, {}, True)
    lexicon = words | _learn(labelled, model, base, words, False)
    dropped(labelled)
    return base, lexicon


def score_texts(rows: DataFrame, text_col: str, model: list[float], base: float, lexicon: dict[str, float]) -> DataFrame:
    """``rows`` with ``score`` in place of the text: the highest score of a feature of a word, at least half the base rate."""
    names = [c for c in rows.columns if c != text_col]
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for b in batches:
            out = []
            for t in b.column(len(names)):
                best = base / 2
                for w in words_of(t.as_py()):
                    p = cache.get(w)
                    if p is None:
                        if len(cache) > 400_000:
                            cache.clear()
                        p = cache[w] = max((lexicon.get(f, 0.0) for f in features(w, model)), default=0.0)
                    if p > best:
                        best = p
                out.append(best)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(names))], pa.array(out, pa.float64())], names=[*names, "score"])

    return rows.select(*names, text_col).mapInArrow(run, kinds + "score double")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learnt from: crc32 of the id as text is 1 modulo 3. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = FIT_ROWS) -> DataFrame:
    """``id_col``, ``held_out`` and ``score`` of every row.

    Labels of held-out ids, null labels and labels of unknown ids are not used; of repeated labels the higher
    counts. A null or empty text scores half the base rate. If all usable labels are equal, or there are none,
    every score is half their mean.
    """
    learn = labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("toxic"))
    learn = learn.orderBy(F.xxhash64("_id"), "_id").limit(limit)
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = character_model(text.select("text"))
    base, lexicon = fit(text.join(small(learn, limit, 100_000), F.col("id") == F.col("_id")).select("text", "toxic"), model)
    return score_texts(text.withColumn("held_out", held_out(F.col("id"))), "text", model, base, lexicon).withColumnRenamed("id", id_col)


def op5_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
