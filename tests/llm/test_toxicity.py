import itertools
import random
import time
import zlib

from pyspark.sql import functions as F

from veritab.llm import toxicity as T


def _exhaustive(word, model):
    """The best reading by trying every path of the lattice (no blanks)."""
    best = None
    options = []
    for i, c in enumerate(word):
        o = [("sub", x, T.SWAP) for x in T.LEET.get(c, "")]
        o += [("sub", c, 0.0)] if c.isalpha() else [] if c in T.FILLERS else [("sub", c, T.STRANGE)]
        o += [("eps", "", T.SKIP)] if c in T.FILLERS else []
        o += [("again", "", T.AGAIN)] if i else []
        options.append(o)
    for path in itertools.product(*options):
        out, cost = "", 0.0
        for i, (kind, x, price) in enumerate(path):
            c = word[i]
            if kind == "again" and not (out and (c == word[i - 1] or out[-1] in T.LEET.get(c, "") or out[-1] == c)):
                break
            out += x
            cost += price
        else:
            t = "  " + out + " "
            cost -= sum(model[(T._code(t[j]) * T.SYMBOLS + T._code(t[j + 1])) * T.SYMBOLS + T._code(t[j + 2])] for j in range(len(t) - 2))
            best = min(best, (cost, out)) if best else (cost, out)
    return best[1]


def test_decode_is_the_best_path(spark):
    text = "the idiot and the moron sat in this house with the thing that is in there " * 30
    model = T.character_model(spark.createDataFrame([(text,), (None,), ("",)], "text string"))
    for w in ("1d10t", "m0r0n", "th1ng", "h.o.u.s.e", "thhhis", "x9", "w1th!"):
        assert T.decode(w, model)[0] == _exhaustive(w, model)
    assert T.decode("1d10t", model)[0] == "idiot" and T.decode("m o r o n", model)[0] == "moron"


def test_held_out_accuracy(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice(["th", "er", "an", "in", "on", "ou"]) for _ in range(rnd.randrange(1, 4)))
    bad = ["idiot", "moron", "scum", "clown"]
    disguise = [lambda w: w, lambda w: w.replace("o", "0").replace("i", "1"), lambda w: " ".join(w), lambda w: w[0] + w[1] * 4 + w[2:], str.upper]
    docs, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        ws = [word() for _ in range(40)]
        for _ in range(3 * toxic):
            ws.insert(rnd.randrange(40), rnd.choice(disguise)(rnd.choice(bad)))
        docs.append((i, " ".join(ws), "s"))
        labels.append((i, 1, int(toxic)))
    docs += [(None, "idiot", "s"), (2000, None, "s"), (2001, "", "s"), (5, docs[5][1], "s"), (2002, "the 1d10t " * 4000, "s")]
    labels += [(None, 1, 1), (7, 1, None), (5, 1, 1), (9999, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = T.toxicity(d, lab).collect()
    assert len(got) == len(docs)
    rows = {r["doc_id"]: r for r in got}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(rows[i]["held_out"] == (i in set(held)) for i in range(900))
    hits = sum((rows[i]["score"] >= 0.7) == (i % 5 == 0) for i in held)
    assert hits >= 0.97 * len(held)
    assert rows[2002]["score"] >= 0.7 and rows[2000]["score"] == rows[2001]["score"] < 0.7
    flipped = lab.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {(r["doc_id"], r["score"]) for r in T.toxicity(d, flipped).collect()} == {(r["doc_id"], r["score"]) for r in got}
    assert T.toxicity(d.limit(0), lab).count() == 0
    assert {r["score"] for r in T.toxicity(d, lab.limit(0)).collect()} == {0.0}


def test_every_path_of_random_lattices(spark):
    """Against all paths, on words that mix every channel; the readings are different and ordered by cost."""
    model = T.character_model(spark.createDataFrame([("the idiot and the moron sat in this house with the thing that is in there " * 30,)], "text string"))
    rnd = random.Random(3)
    for _ in range(150):
        w = "".join(rnd.choice("01345@$!.-*aeinothss") for _ in range(rnd.randrange(2, 7)))
        if any(c not in T.FILLERS for c in w):
            got = T.decode(w, model)
            assert len(set(got)) == len(got) and got[0] == _exhaustive(w, model), w


def test_long_words_and_spacing(spark):
    model = T.character_model(spark.createDataFrame([("the idiot and the moron " * 30,)], "text string"))
    long = "1d10t" * 20_000
    start = time.monotonic()
    assert len(T.decode(long, model)[0]) > 20_000
    assert time.monotonic() - start < 60
    for t in ("m o r o n!", "m o r o n. ok", "x m  o  r  o  n", "m\to\tr\to\tn", "m\no\nr\no\nn, go", "m,o,r,o,n", "mmorron", "m0r0n"):
        assert any("moron" in T.features(w, model) for w in T.words_of(t)), t
