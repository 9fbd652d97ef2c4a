import collections
import math
import random
import re

from pyspark.sql import functions as F

from veritab.llm import quality as Q

W = re.compile(r"[^\x20\x09-\x0D]+")


def _brute(t):
    t = t or ""
    w = W.findall(t)
    seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if W.search(x)]
    return len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(cover)


def test_counts(spark):
    rnd = random.Random(3)
    texts = [None, "", " \n\t", "a", "a a a a", "a b c a b c", "x\n\nx\n x\nx", "é#ü $ 😀😀 ok", "  b c", "a b c d " * 3000, " lead and trail \x0b\x0c"]
    texts += [" ".join(rnd.choice("ab c\n") for _ in range(rnd.randrange(60))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_words long")
    got = Q.text_stats(df.drop("n_words"), "text").collect()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == _brute(texts[r["doc_id"]])
        n, *_, rep = _brute(texts[r["doc_id"]])
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n)


def test_binomial(spark):
    for n, k, p in [(10, 0, 0.1), (10, 3, 0.1), (400, 9, 0.05), (1, 1, 0.3)]:
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        row = spark.range(1).select(Q.binomial_cdf(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("x")).first()
        assert abs(row["x"] - want) < 1e-9


def test_junk_goes_and_good_stays(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    docs, labels = [], []
    for i in range(6000):
        good = i % 4 != 0
        text = " ".join(word() + ("" if good else "$$$") for _ in range(55))
        docs.append((i, text, ["en", None][i % 2], "s"))
        labels.append((i, int(good), 0))
    docs += [(None, None, None, None), (3, "short", "xx", "s"), (90000, docs[1][1], "xx", None), (90000, docs[1][1], "xx", None)]
    labels += [(None, 1, 0), (3, 0, 1), (7, None, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, kept string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = Q.good_rows(d, lab)
    assert kept.columns == d.columns
    ids = collections.Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    assert ids[90000] == 2 and None not in ids
    want = {i for i, t, *_ in docs[:6000] if i % 4 != 0} | {90000}
    assert set(ids) == want
    assert Q.good_rows(d.limit(0), lab).count() == 0 and Q.good_rows(d, lab.limit(0)).count() == 6002
