"""Quality rules with risk-controlled thresholds, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.llm.common import SPACE, let, saved, small, table

#: Signals that may reject, each a share from 0 to 1 that grows with poorness.
SIGNALS = ("symbol_share", "upper_share", "mark_share", "dup_line_share", "repeat_share")
#: Cutoffs that are tested for each signal.
GRID = (0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.18, 0.25, 0.35, 0.5, 0.7)


def _repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window that occurs twice or more in ``w``, first occurrences included."""
    n = F.size(w)
    windows = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))

    def places(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda s: F.transform(F.filter(s, lambda x, j: F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda p: F.array(p, p + 1, p + 2)))))

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(places(h)))


def text_counts(text: Column) -> dict[str, Column]:
    """Counts of a whole text (null: empty). Words are split at U+0020 and U+0009 to U+000D."""
    t = F.coalesce(text, F.lit(""))
    bare = F.length(F.translate(t, " \t\n\x0b\x0c\r", ""))
    words = let(F.filter(F.split(t, SPACE), lambda w: w != ""), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("r")))
    lines = let(F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    return {
        "word_chars": bare.cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
        "n_upper": (F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
        "n_marks": (F.length(t) - F.length(F.translate(t, "!?~^=+{}[]\\", ""))).cast("long"),
        "w": words,
        "l": lines,
    }


def text_stats(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` without the text, with counts, signals and ``base_failed``."""
    out = rows.withColumns(text_counts(F.col(text_col))).drop(text_col)
    out = out.withColumns({"n_words": F.col("w.n"), "n_repeat_words": F.col("w.r"), "n_lines": F.col("l.n"), "n_dup_lines": F.col("l.d")}).drop("w", "l")
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return out.withColumns(
        {
            "symbol_share": share("n_symbols", "word_chars"),
            "upper_share": share("n_upper", "word_chars"),
            "mark_share": share("n_marks", "word_chars"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    )


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed term by term in logarithms."""
    step = F.log(F.lit(p / (1 - p)))
    start = F.struct((n * F.log(F.lit(1 - p))).alias("t"), F.exp(n * F.log(F.lit(1 - p))).alias("s"))

    def add(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.log((n - i + 1) / i) + step
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    upto = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(upto, start, add)["s"]


def thresholds(judged: DataFrame, alpha: float, delta: float) -> DataFrame:
    """Certified cutoffs per stratum: stratum and, for each signal, ``<signal>_cut`` (null: none).

    ``judged`` has stratum, good (boolean), fold (0 fits, 1 is the holdout) and the signals. The fitting fold gives
    each signal of a stratum the cutoff of GRID with the best gain (bad rows rejected less 5 x good rows rejected;
    ties: the higher cutoff), and orders the signals with a positive gain by it. The rules "the first r signals
    reject" are nested, and the holdout tests them in this order: rule r is certified if its k rejections among n
    good rows give P(Bin(n, alpha) <= k) <= delta / strata, and testing stops at the first that fails. A fixed
    sequence needs no further correction, so with probability 1 - delta no stratum loses more than ``alpha`` of its
    good rows (Bonferroni over strata).
    """
    fit, hold = judged.filter("fold = 0"), judged.filter("fold = 1 and good")
    each = F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(c).alias("cutoff"), (F.col(s) >= c).cast("long").alias("hit")) for s in SIGNALS for c in GRID])
    gain = F.sum(F.col("x.hit") * F.when(F.col("good"), -5).otherwise(1)).alias("gain")
    gains = fit.select("stratum", "good", F.explode(each).alias("x")).groupBy("stratum", "x.signal", "x.cutoff").agg(gain).filter("gain > 0")
    best = gains.groupBy("stratum", "signal").agg(F.max(F.struct("gain", "cutoff")).alias("b")).select("stratum", "signal", "b.*")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("gain"), "signal")))
    of = lambda s, c: F.max(F.when(F.col("signal") == s, F.col(c)))
    wide = saved(best.groupBy("stratum").agg(*[of(s, "cutoff").alias(f"{s}_cut") for s in SIGNALS], *[of(s, "rank").alias(f"{s}_rank") for s in SIGNALS]), "quality-paths")
    first = F.least(*[F.when(F.col(s) >= F.col(f"{s}_cut"), F.col(f"{s}_rank")) for s in SIGNALS])
    ranks = range(1, len(SIGNALS) + 1)
    k = hold.join(small(wide, wide.count(), 100_000), "stratum").withColumn("first", first).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("first") <= r).alias(f"k{r}") for r in ranks])
    strata = judged.agg(F.greatest(F.count_distinct("stratum"), F.lit(1)).alias("strata"))
    k = k.join(F.broadcast(strata))  # strata: one row
    passed = [F.when(binomial_cdf(F.col(f"k{r}"), F.col("n"), alpha) * F.col("strata") <= delta, r) for r in ranks]
    k = k.select("stratum", F.greatest(*passed).alias("upto")).filter("upto is not null")  # k grows with r, so what passes is a beginning
    return wide.join(k, "stratum").select("stratum", *[F.when(F.col(f"{s}_rank") <= F.col("upto"), F.col(f"{s}_cut")).alias(f"{s}_cut") for s in SIGNALS])


def judge(stats: DataFrame, labels: DataFrame, id_col: str, stratum_col: str, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Add ``kept`` and the cutoffs of the row's stratum to :func:`text_stats` rows.

    ``labels`` has ``id_col`` and quality (1: good); conflicting or null labels of an id are left out. Rows that
    fail the base rule are rejected and not used to calibrate. A stratum (null is one of its own) that has too
    few labelled rows to certify a cutoff rejects nothing beyond the base rule. Null ids are never labelled.
    """
    clean = labels.filter(F.col("quality").isNotNull()).groupBy(id_col).agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).filter("q = q2").select(F.col(id_col).alias("label_id"), (F.col("q") == 1).alias("good"))
    named = F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit("null"))
    stats = stats.withColumn("stratum", named)
    fold = F.conv(F.substring(F.md5(F.concat(F.lit("fold:"), F.col(id_col).cast("string"))), 1, 1), 16, 10).cast("int") % 2
    judged = stats.filter(~F.col("base_failed")).join(clean, F.col(id_col) == F.col("label_id")).select("stratum", "good", fold.alias("fold"), *SIGNALS)
    cuts = saved(thresholds(judged, alpha, delta), "quality-cuts")
    out = stats.join(small(cuts, cuts.count(), 100_000), "stratum", "left")
    bad = F.lit(False)
    for s in SIGNALS:
        bad = bad | F.coalesce(F.col(s) >= F.col(f"{s}_cut"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~bad)


def op8_risk_controlled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    stats = saved(text_stats(docs, "text"), "quality-stats")
    out = judge(stats, table(spark, sf_dir, "labels"), "doc_id", "lang")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def good_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns. Texts are measured once and written with their counts."""
    names = docs.columns
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{stratum_col}`").alias("_stratum"), F.col(f"`{text_col}`").alias("_text"))
    wide = saved(text_stats(wide, "_text"), "quality-rows")
    out = judge(wide, labels.withColumnRenamed(id_col, "_id"), "_id", "_stratum")
    return out.filter("kept").select("_row.*")


OP8_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, 'null') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
x AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT j) AS r FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM x WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS l FROM d),
c AS (
  SELECT doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(t, '[^!?~^=+{{}}\[\]\\]', '', 'g')) AS n_marks, len(l) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words
  FROM d JOIN w USING (doc_id) JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
s AS (
  SELECT *, n_symbols / greatest(word_chars, 1) AS symbol_share, n_upper / greatest(word_chars, 1) AS upper_share,
         n_marks / greatest(word_chars, 1) AS mark_share, n_dup_lines / greatest(n_lines, 1) AS dup_line_share,
         n_repeat_words / greatest(n_words, 1) AS repeat_share, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
lab AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = max(quality)),
j AS (SELECT s.*, good, md5('fold:' || doc_id)[1] IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') AS certifies FROM s JOIN lab USING (doc_id) WHERE NOT base_failed),
v AS (SELECT doc_id, stratum, good, certifies, unnest([{", ".join(f"{{'signal': '{x}', 'v': {x}}}" for x in SIGNALS)}], recursive := true) FROM j),
t AS (
  SELECT stratum, signal, cutoff, count(*) FILTER (NOT good AND v >= cutoff) - 5 * count(*) FILTER (good AND v >= cutoff) AS gain
  FROM v, (SELECT unnest([{", ".join(map(str, GRID))}]::DOUBLE[]) AS cutoff) WHERE NOT certifies GROUP BY ALL),
b AS (SELECT stratum, signal, max(gain) AS gain, arg_max(cutoff, (gain, cutoff)) AS cutoff FROM t WHERE gain > 0 GROUP BY stratum, signal),
o AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, signal) AS rank FROM b),
f AS (SELECT doc_id, stratum, min(rank) FILTER (v >= cutoff) AS first FROM v JOIN o USING (stratum, signal) WHERE good AND certifies GROUP BY doc_id, stratum),
k AS (SELECT o.stratum, o.rank, count(*) AS n, count(*) FILTER (first <= rank) AS k FROM o JOIN f USING (stratum) GROUP BY o.stratum, o.rank),
z AS (
  SELECT *, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05) + (n - i) * ln(0.95)))) AS p FROM k),
u AS (SELECT stratum, max(rank) AS upto FROM z WHERE p * (SELECT count(DISTINCT stratum) FROM j) <= 0.05 GROUP BY stratum),
c2 AS (SELECT stratum, signal, cutoff FROM o JOIN u USING (stratum) WHERE rank <= upto),
bad AS (SELECT DISTINCT s.doc_id FROM s JOIN c2 USING (stratum) WHERE CASE signal {" ".join(f"WHEN '{x}' THEN {x}" for x in SIGNALS)} END >= cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM s
"""
