import hashlib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from veritab.llm import secrets as S

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def _base(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_base_and_added_spans(spark):
    rnd = random.Random(1)
    key = lambda n, a="0123456789abcdef": "".join(rnd.choice(a) for _ in range(n))
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = [None, "", "plain", "password=abc", "token=secret=abcdefgh", "password=token: abcdef", "😀é API_KEY : 'abcdef' x", "apikey\"=\"zz.yy=9", "AKIAAKIA" + "B" * 15, "AKIA" + "Z9" * 8, "paſsword=abcdefgh", "x" + key(24) + "g" + key(23), "secret = " + key(40) + " and " + key(30), "token  :=abcdefg", "password=" + key(5000)]
    texts += [f"word number{i} passwd: {key(18)} tail {key(32, mixed)}" for i in range(30)]
    texts += ["ordinary identifiers such as connectionhandlerfactory and userpreferencesdialog are common " * 3] * 40
    texts.append("the leaked value " + (leak := key(40, mixed)) + " stands here beside internationalisation_of_names")
    df = spark.createDataFrame([(i, t, "e", "b", 1) for i, t in enumerate(texts)], "doc_id long, text string, extra string, base string, tokens int")
    out = S.scan(df, "text", share=1)
    assert out.columns == ["doc_id", "extra", "tokens", "base", "spans"]
    for r in out.select("doc_id", "base", "spans", F.sha2(S.said(F.col("base")), 256).alias("h")).collect():
        want = _base(texts[r["doc_id"]])
        assert [(s["start"], s["kind"], s["stop"]) for s in r["base"]] == want, texts[r["doc_id"]]
        assert {tuple(s) for s in r["base"]} <= {tuple(s) for s in r["spans"]}
        assert r["h"] == hashlib.sha256(",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
        if r["doc_id"] == len(texts) - 1:
            assert [s["token"] for s in r["spans"]] == [leak]
        if "ordinary" in (texts[r["doc_id"]] or ""):
            assert r["spans"] == []
    assert S.scan(df.limit(0), "text").count() == 0
    assert [r["spans"] for r in S.scan(df.filter("doc_id = 2"), "text").collect()] == [[]]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the given tables")
def test_planted_tokens_with_production_parameters(spark):
    rnd = random.Random(3)
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    planted = {n: ["".join(rnd.choice(mixed) for _ in range(n)) for _ in range(100)] for n in (16, 24, 32)}
    rows = [(10**9 + 1000 * n + i, f"the value {t} stands here") for n, ts in planted.items() for i, t in enumerate(ts)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {s["token"] for r in S.scan(docs, "text").filter(F.col("doc_id") >= 10**9).collect() for s in r["spans"]}
    share = {n: sum(t in found for t in ts) for n, ts in planted.items()}
    assert all(n >= 98 for n in share.values()), share


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the given tables")
def test_false_rate_on_ordinary_text(spark):
    """Neighbouring words glued together as long identifiers, which no model saw: hardly any of them counts as random."""
    rnd = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    words = [w for r in docs.filter("doc_id < 300").collect() for w in re.findall(r"[A-Za-z]{3,}", r.text or "")]
    glued = {rnd.choice(["", "_"]).join(words[i : i + 4])[: rnd.choice([16, 24, 32])] for i in rnd.sample(range(len(words) - 4), 2_000)}
    glued = sorted(x for x in glued if len(x) >= 16)
    rows = spark.createDataFrame([(10**9 + i, f"a {t} b") for i, t in enumerate(glued)], "doc_id long, text string")
    found = S.scan(docs.unionByName(rows), "text").filter((F.col("doc_id") >= 10**9) & (F.size("spans") > 0)).count()
    assert len(glued) > 1_000 and found <= 0.01 * len(glued), (found, len(glued))


def test_many_hits_take_linear_time(spark):
    import time

    df = spark.createDataFrame([("token=abcdefgh ",)], "t string").withColumn("t", F.repeat("t", 40_000))
    began = time.time()
    assert df.select(F.size(S.find_base(F.col("t")))).first()[0] == 40_000 and time.time() - began < 15
