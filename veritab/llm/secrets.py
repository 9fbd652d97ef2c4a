"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions.spans import running
from veritab.llm.common import SPACE, let, saved, table

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Tokens that the models judge: whole runs of CHARS of at least MIN_TOKEN with a letter (others are numbers).
MIN_TOKEN = 16
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{%d,}" % MIN_TOKEN
KINDS = ("assign", "access", "hex", "markov")
SPAN = "array<struct<start:int,kind:int,stop:int,token:string>>"
#: Share of held-out ordinary words that may count as random, and the scores among which the cutoff is chosen.
FALSE_RATE, GRID = 1e-4, [x / 4 for x in range(4, 61)]
#: Share of random strings that must reach the cutoff.
FOUND = 0.98
#: Held-out words that are enough to set a cutoff; with fewer all words train the model and set the cutoff.
HELD = 100


def _spans(text: Column, gate: str, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Matches of ``pattern`` with code-point positions: a split at the pattern gives what lies between matches."""

    def place(found: Column) -> Column:
        ends = let(F.split(text, pattern, -1), lambda gaps: running(F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))))
        token = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        at = lambda e: F.transform(found, lambda m, i: F.struct((F.get(e, i) - F.length(m)).cast("int").alias("start"), F.lit(kind).alias("kind"), F.get(e, i).cast("int").alias("stop")))
        both = F.zip_with(let(ends, at), token, lambda s, t: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), t.alias("token")))
        return F.filter(both, lambda s: F.length(s["token"]) >= least)

    hits = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)
    return F.coalesce(F.when(text.rlike(gate), hits), F.array().cast(SPAN)).cast(SPAN)


def find_base(text: Column) -> Column:
    """Spans of the three fixed kinds, by start and then kind. A null text has none."""
    every = F.concat(
        _spans(text, ASSIGN.removesuffix("+)") + "{6,})", ASSIGN, 0, group=2, least=6),
        _spans(text, ACCESS, ACCESS, 1),
        _spans(text, HEX, HEX, 2),
    )
    return F.sort_array(every)


def bigrams(samples: DataFrame) -> DataFrame:
    """(token, weight) -> cell, n: counts of neighbouring characters; cell is 68 * first + second, 0 for the start."""
    t = F.concat(F.lit(" "), F.col("token"))
    pairs = F.transform(F.sequence(F.lit(2), F.length(t)), lambda i: _cell(t, i))
    return samples.filter(F.length("token") > 0).select(F.explode(pairs).alias("cell"), "weight").groupBy("cell").agg(F.sum("weight").alias("n"))


def _cell(t: Column, i: Column) -> Column:
    return (68 * F.instr(F.lit(CHARS), t.substr(i - 1, F.lit(1))) + F.instr(F.lit(CHARS), t.substr(i, F.lit(1)))).cast("int")


def train(random: DataFrame, ordinary: DataFrame) -> list[float]:
    """Log-likelihood ratios of the 68 x 68 cells, from labelled samples (token, weight) of either class.

    Each model gives log p(second | first), with half a count added to every cell. The two tables that come to
    the driver have 4,624 rows at most, whatever the samples.
    """
    logs = []
    for samples in (random, ordinary):
        n = [0.5] * (68 * 68)
        for r in bigrams(samples).collect():
            n[r["cell"]] += r["n"]
        logs.append((n, [sum(n[68 * a + 1 : 68 * a + 68]) for a in range(68)]))
    (r, rs), (o, os) = logs
    return [math.log(r[c] / rs[c // 68]) - math.log(o[c] / os[c // 68]) for c in range(68 * 68)]


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token: random over ordinary."""
    cells = F.from_json(F.lit(json.dumps([round(x, 6) for x in model])), "array<double>")
    t = F.concat(F.lit(" "), token)
    return F.aggregate(F.sequence(F.lit(2), F.length(t)), F.lit(0.0), lambda acc, i: acc + F.get(cells, _cell(t, i)))


def calibrated(words: DataFrame, secrets: DataFrame, model: list[float], false_rate: float, found: float = FOUND) -> tuple[float, float, float]:
    """(mean, deviation, cutoff) from ordinary words (token) that the model was not trained on, and from random strings.

    A ratio is a sum over characters, so an ordinary word of n characters has about n times the mean and root n times the
    deviation of one; a token's score is how many deviations its ratio lies above that. The cutoff is the least of
    GRID that at most a share of ``false_rate`` of the words reaches, but no higher than what a share of ``found`` of
    the random strings reaches: where the classes overlap, a missed secret is worse than a word too many.
    """
    scored = lambda t: t.select(F.length("token").cast("double").alias("n"), ratio(F.col("token"), model).alias("r"))
    r, s = scored(words), scored(secrets.filter(F.length("token") >= MIN_TOKEN))
    m = r.agg(F.sum("r"), F.sum("n"), F.sum(F.col("r") * F.col("r")), F.sum(F.col("r") * F.col("n")), F.sum(F.col("n") * F.col("n"))).first()
    if not m[1]:
        m = (0.0, 1.0, 1.0, 0.0, 1.0)
    mean = m[0] / m[1]
    deviation = math.sqrt(max((m[2] - 2 * mean * m[3] + mean * mean * m[4]) / m[1], 1e-9))
    z = (F.col("r") - mean * F.col("n")) / (deviation * F.sqrt("n"))
    over = [x.agg(F.count(F.lit(1)), *[F.count_if(z >= c) for c in GRID]).first() for x in (r, s)]
    least = next((c for c, k in zip(GRID, over[0][1:], strict=True) if k <= false_rate * over[0][0]), GRID[-1])
    most = max((c for c, k in zip(GRID, over[1][1:], strict=True) if k >= found * over[1][0]), default=GRID[0])
    return mean, deviation, min(least, most)


def scan(rows: DataFrame, text_col: str, share: int = 1, false_rate: float = FALSE_RATE) -> DataFrame:
    """Replace ``text_col`` by ``base`` and ``spans``: arrays of (start, kind, stop, token), by start and kind.

    The labelled samples are taken from the rows: random strings are the hits of the fixed patterns in all rows
    and ordinary identifiers are the words that recur (three times or more: secrets rarely do) in all rows without
    hits, or in one row in ``share`` (by hash of the text) where a caller asks for less. A quarter of the ordinary words
    (by hash) is held out and sets the cutoff with the random strings, see :func:`calibrated` and HELD. Tokens of MIN_TOKEN characters or more that no
    base span touches are added if their score reaches it and their ratio log(1 / false_rate): under the ordinary model
    a token reaches that with a probability of ``false_rate`` at most.

    A null or empty text has no spans. Without any hit there are no random samples and nothing is added. Repeated
    rows are all kept; other columns stay, but columns named base and spans are replaced.
    """
    others = [F.col(f"`{c}`") for c in rows.columns if c not in (text_col, "base", "spans")]
    text = F.col(f"`{text_col}`")
    sampled = F.when(F.pmod(F.xxhash64(text), F.lit(share)) == 0, text)
    found = saved(
        rows.select(F.struct(*others or [F.lit(0).alias("_")]).alias("_d"), find_base(text).alias("base"), _spans(text, TOKEN, TOKEN, 3).alias("tokens"), sampled.alias("_text")),
        "secret-spans",
    )
    hits = found.select(F.explode("base").alias("s")).select("s.token").groupBy("token").agg(F.count(F.lit(1)).alias("weight"))
    words = found.filter(F.size("base") == 0).select(F.explode(F.split("_text", SPACE)).alias("token")).filter(F.length("token") >= 4).groupBy("token").agg(F.count(F.lit(1)).alias("weight"))
    found = found.drop("_text")
    none = F.array().cast(SPAN)
    words = saved(words.filter("weight >= 3").withColumn("held", F.pmod(F.xxhash64("token"), F.lit(4)) == 0), "ordinary-words")
    judged = words.filter(F.col("token").rlike("^[A-Za-z0-9+/_=-]+$"))
    apart = judged.filter("held").count() >= HELD
    model = train(hits.withColumn("weight", F.lit(1)), words.filter(~F.col("held")) if apart else words)
    mean, deviation, cutoff = calibrated(judged.filter("held") if apart else judged, hits, model, false_rate)
    free = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])))
    n = lambda t: F.length(t["token"])
    extra = F.filter(free, lambda t: ratio(t["token"], model) >= F.greatest(F.lit(math.log(1 / false_rate)), mean * n(t) + cutoff * deviation * F.sqrt(n(t))))
    more = F.when(F.size("tokens") > 0, extra).otherwise(none) if hits.limit(1).count() else none
    out = found.select("_d.*", "base", F.sort_array(F.concat("base", more)).alias("spans"))
    return out if others else out.drop("_")


def said(spans: Column) -> Column:
    """kind:start:stop of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op2_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
