"""Benchmark decontamination by exact similarity of item-sized windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.llm.common import SPACE, let, saved, small, table

SHINGLE, SIMILARITY = 5, 0.8
#: Rows up to which a side of a join may be broadcast: at most some 20 MB.
BROADCAST = 500_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")


def shingles_of(words: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words; none if there are fewer words."""
    at = F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0)))
    each = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    return F.when(F.size(words) >= k, each).otherwise(F.array().cast("array<bigint>"))


def leaks(rows: DataFrame, text_col: str, items: DataFrame, item_col: str, item_text: str, similarity: float = SIMILARITY) -> DataFrame:
    """(text_key, item, start, words, similarity): where texts hold windows near to benchmark items.

    A window has as many words as the item (or all words of a shorter text). Its similarity to the item is the
    weight of the item's shingles of five words that the window holds, repeats counted, over the weight of all the
    item's shingles; a shingle weighs 1 + ln((1 + items) / (1 + items that have it)). An item of fewer than five
    words is one shingle.

    No window is lost. A window that misses all shingles of a set that weighs more than 1 - ``similarity`` of the
    item is too far, so texts and items meet on such a set, the item's rarest shingles, by an equi-join. Moving a
    window on to its first shared shingle, or to the end of the text, loses none of its shared shingles: windows
    that start there are enough to find every item and the highest similarity. Windows and shared shingles of one
    text and item meet by stretches of the item's length, so a long text makes no product.

    ``text_key`` is :func:`text_key` of the text; equal texts are judged once. Null, empty and wordless texts and
    items match nothing; repeated items are items of their own if their ids differ.
    """
    it = items.select(F.col(item_col).alias("item"), words_of(F.col(item_text)).alias("w")).filter(F.size("w") > 0).dropDuplicates(["item"])
    it = saved(it.select("item", F.size("w").alias("n"), F.least(F.size("w"), F.lit(SHINGLE)).alias("k"), "w"), "items")
    n_items = it.count()
    sizes = sorted(r[0] for r in it.select("k").distinct().collect()) or [SHINGLE]  # at most SHINGLE values
    hashed = F.coalesce(*[F.when(F.col("k") == k, shingles_of(F.col("w"), k)) for k in sizes])
    sh = it.select("item", "n", "k", F.explode(hashed).alias("h")).groupBy("item", "n", "k", "h").agg(F.count(F.lit(1)).alias("c0"))
    df = sh.groupBy("h").agg(F.count(F.lit(1)).alias("items"))
    sh = sh.join(df, "h").withColumn("weight", 1 + F.log(F.lit(float(1 + n_items)) / (1 + F.col("items"))))
    rare = Window.partitionBy("item").orderBy(F.desc("weight"), "h").rowsBetween(Window.unboundedPreceding, -1)
    sh = sh.withColumns({"all": F.sum(F.col("c0") * F.col("weight")).over(Window.partitionBy("item")), "before": F.coalesce(F.sum(F.col("c0") * F.col("weight")).over(rare), F.lit(0.0))})
    sh = saved(sh, "item-shingles")
    n_sh = sh.count()
    first = sh.filter(F.col("before") <= (1 - similarity + 1e-9) * F.col("all")).select("h", "item")

    keyed = rows.select(F.col(text_col).alias("text")).filter("text is not null").withColumn("text_key", text_key(F.col("text")))
    spots_of = lambda w: F.concat(*[F.transform(shingles_of(w, k), lambda h, i: F.struct(h.alias("h"), i.alias("i"), F.size(w).alias("m"))) for k in sizes])
    spots = keyed.select("text_key", F.explode(let(words_of(F.col("text")), spots_of)).alias("x")).select("text_key", "x.h", "x.i", "x.m")
    spots = spots.join(small(sh.select("h").distinct(), n_sh, BROADCAST), "h", "left_semi")
    spots = saved(spots.distinct(), "shared-places")
    pairs = saved(spots.join(small(first, n_sh, BROADCAST), "h").select("text_key", "item").distinct(), "text-items")
    n_pairs = pairs.count()
    hits = spots.join(small(sh.select("item", "n", "k", "h", "c0", "weight", "all"), n_sh, BROADCAST), "h")
    hits = saved(hits.join(small(pairs, n_pairs, BROADCAST), ["text_key", "item"], "left_semi"), "shared-shingles")

    key = ["text_key", "item"]
    start = F.greatest(F.lit(0), F.least(F.col("i"), F.col("m") - F.col("n")))
    windows = hits.select(*key, start.alias("start"), "n", F.least("n", "m").alias("words")).distinct()
    stretch = F.floor(F.col("start") / F.col("n"))
    windows = windows.select(*key, "start", "words", F.explode(F.array(stretch, stretch + 1)).alias("at"))
    met = windows.join(hits.withColumn("at", F.floor(F.col("i") / F.col("n"))), [*key, "at"]).filter("i >= start and i <= start + words - k")
    held = met.groupBy(*key, "start", "words", "h", "c0", "weight", "all").agg(F.count(F.lit(1)).alias("c"))
    got = held.groupBy(*key, "start", "words", "all").agg(F.sum(F.least("c", "c0") * F.col("weight")).alias("got"))
    out = got.withColumn("similarity", F.round(F.col("got") / F.col("all"), 9))
    return out.filter(F.col("similarity") >= similarity).select(*key, "start", "words", "similarity")


def text_key(text: Column) -> Column:
    """96 bits of hash that stand for a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.hash(text).alias("b"))


def contaminated(rows: DataFrame, text_col: str, items: DataFrame, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(text_key, item_ids, similarity): one row for each text that holds an item, with all its items."""
    found = leaks(rows, text_col, items, item_col, item_text)
    return found.groupBy("text_key").agg(F.sort_array(F.collect_set("item")).alias("item_ids"), F.max("similarity").alias("similarity"))


def clean_rows(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item."""
    names = docs.columns
    bad = saved(contaminated(docs, text_col, items).select("text_key"), "leaks")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_d"), text_key(F.col(f"`{text_col}`")).alias("text_key"))
    return keyed.join(small(bad, bad.count(), BROADCAST), "text_key", "left_anti").select("_d.*")


def op3_simhash_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bad = saved(contaminated(docs, "text", table(spark, sf_dir, "benchmark")), "leaks")
    out = docs.select("doc_id", text_key(F.col("text")).alias("text_key")).join(small(bad, bad.count(), BROADCAST), "text_key", "left")
    ids = F.coalesce(F.col("item_ids"), F.array().cast("array<bigint>"))
    return out.select("doc_id", (F.size(ids) > 0).alias("contaminated"), F.size(ids).alias("n_items"), F.array_join(ids.cast("array<string>"), ",").alias("item_ids"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


OP3_SQL = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL),
it AS (SELECT item_id, w, len(w) AS n, least(len(w), 5) AS k FROM iw WHERE len(w) > 0),
sh AS (SELECT item_id, n, k, p, array_to_string(w[p + 1:p + k], ' ') AS s FROM (SELECT *, unnest(range(0, n - k + 1)) AS p FROM it)),
wt AS (SELECT k, s, 1 + ln((1 + (SELECT count(*) FROM it)) / (1 + count(DISTINCT item_id))) AS weight FROM sh GROUP BY k, s),
want AS (SELECT item_id, n, k, s, count(*) AS c0 FROM sh GROUP BY ALL),
whole AS (SELECT item_id, sum(c0 * weight) AS total FROM want JOIN wt USING (k, s) GROUP BY item_id),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
dk AS (SELECT doc_id, w, len(w) AS m, k FROM dw, (SELECT DISTINCT k FROM it)),
ds AS (SELECT doc_id, m, k, i, array_to_string(w[i + 1:i + k], ' ') AS s FROM (SELECT *, unnest(range(0, greatest(m - k + 1, 0))) AS i FROM dk)),
hit AS (SELECT ds.* FROM ds SEMI JOIN sh ON ds.k = sh.k AND ds.s = sh.s),
near AS (SELECT DISTINCT doc_id, m, n, k, i FROM hit JOIN sh USING (k, s)),
win AS (SELECT DISTINCT doc_id, n, k, m, unnest(range(greatest(0, least(i - (n - k), m - n)), greatest(0, least(i, m - n)) + 1)) AS st FROM near),
have AS (SELECT win.doc_id, win.n, win.k, st, s, count(*) AS c FROM win JOIN hit ON hit.doc_id = win.doc_id AND hit.k = win.k AND i >= st AND i <= st + least(win.n, win.m) - win.k GROUP BY ALL),
got AS (SELECT doc_id, st, item_id, sum(least(c, c0) * weight) AS g FROM have JOIN want USING (n, k, s) JOIN wt USING (k, s) GROUP BY doc_id, st, n, item_id),
ok AS (SELECT doc_id, item_id, round(g / total, 9) AS sim FROM got JOIN whole USING (item_id) WHERE round(g / total, 9) >= 0.8),
fin AS (SELECT doc_id, list_sort(list_distinct(list(item_id))) AS ids, max(sim) AS sim FROM ok GROUP BY doc_id)
SELECT doc_id, ids IS NOT NULL AS contaminated, coalesce(len(ids), 0) AS n_items, coalesce(array_to_string(ids, ','), '') AS item_ids, coalesce(sim, 0.0) AS similarity
FROM documents LEFT JOIN fin USING (doc_id)
"""
