import random
import re
from collections import Counter

import duckdb
import pytest

from veritab.llm import collocations


def brute(rows, longest=3, least=10, share=50, top=2000):
    out = []
    for lang in {x if x is not None else "und" for x, _ in rows}:
        f, n = Counter(), 0
        for own, text in rows:
            if (own if own is not None else "und") == lang:
                low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
                for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
                    w = re.findall(r"[^\x20\x09]+", piece)
                    n += len(w)
                    f.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
        good = {p: c for p, c in f.items() if 2 <= len(p) and c >= least}
        inside = {}
        for p, c in good.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    q = p[i : i + k]
                    inside[q] = max(inside.get(q, 0), c)
        found = []
        for p, a in good.items():
            if 100 * inside.get(p, 0) < share * a:
                score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n, -score) for i, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def corpus(seed, docs=300):
    r = random.Random(seed)
    words = ["New", "york", "city", "a", "b", "é", "É", "\x1c", "of", "the", "x y", "日本"]
    gaps = [" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", " ! "]
    out = [(r.choice(["en", "de", None, "und"]), "".join(r.choice(words[: r.randrange(2, 13)]) + r.choice(gaps) for _ in range(r.randrange(60)))) for _ in range(docs)]
    return out + [("en", None), ("en", ""), ("en", " .,"), ("fr", "one two"), ("en", "hot pair " * 3_000), ("en", "hot pair " * 3_000)]


@pytest.mark.parametrize("longest", [2, 3, 5])
def test_against_brute_force(spark, longest):
    rows = corpus(longest)
    df = spark.createDataFrame([(x, t, 1) for x, t in rows], "`my.lang` string, `my.text` string, f int").repartition(7)
    assert rows_of(collocations.collocations(df, "my.lang", "my.text", longest)) == brute(rows, longest)


def test_top_and_limits(spark):
    rows = corpus(9)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert rows_of(collocations.collocations(df, "lang", "text", 4, 3, 70, 5)) == brute(rows, 4, 3, 70, 5)


def test_long_texts_are_cut_at_ends_of_pieces(monkeypatch):
    import pyarrow as pa
    import zstandard

    monkeypatch.setattr(collocations, "BLOCK", 20)
    monkeypatch.setattr(collocations.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda s: 0})())
    text = "a b c. " * 50 + "d e " * 50 + ", a b"
    got = list(collocations._words(iter([pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], names=["lang", "text"])])))
    pieces, names = [], {}
    for b in got:
        for r in b.to_pylist():
            if r["seq"] is None:
                names[r["uid"]] = r["word"]
    for b in got:
        for r in b.to_pylist():
            if r["seq"] is not None:
                own = [names.get((r["block"] << collocations.LID) + int(i), ".") for i in __import__("numpy").frombuffer(zstandard.decompress(r["seq"]), "int32")]
                pieces += [p.split() for p in " ".join(own).split(".") if p.split()]
    assert pieces == [p.split() for p in re.split("[.,]", text) if p.split()]


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string"), "lang", "text").collect() == []


def test_query_against_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(collocations.OP11_SQL)
    names = want.columns
    want = sorted(tuple(dict(zip(names, r, strict=True))[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in want.fetchall())
    got = rows_of(collocations.op11_pair_collocations(spark, sf))
    assert got == want and got
    docs = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got == brute(docs)
