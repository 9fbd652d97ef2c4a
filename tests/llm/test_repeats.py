import random

import numpy as np
import pytest

from veritab.llm import repeats as R


def _brute(docs):
    first = {}
    for i, t in docs:
        raw = (t or "").encode()
        for a in range(len(raw) - 49):
            s = raw[a : a + 50]
            first[s] = min(first.get(s, i), i)
    out = {}
    for i, t in docs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 2, dtype=np.int8)
        for a in range(len(raw) - 49):
            if first[raw[a : a + 50]] < i:
                gone[a + 1 : a + 51] = 1
        starts = int((np.diff(gone) == 1).sum())
        out[i] = (bytes(b for b, g in zip(raw, gone[1:], strict=False) if not g), len(raw), int(gone.sum()), starts)
    return out


def _docs(seed, n):
    rnd = random.Random(seed)
    syl = ["th", "er", "é", "an", "on ", "in", "\n", "ß ", "ing", "ea"]
    say = lambda k: "".join(rnd.choice(syl) for _ in range(k))
    share = [say(rnd.randrange(8, 90)) for _ in range(12)]
    docs = []
    for i in range(n):
        t = say(rnd.randrange(60))
        for _ in range(rnd.randrange(4)):
            p = rnd.choice(share)
            t += p[rnd.randrange(4) :] + say(rnd.randrange(30))
        if docs and i % 7 == 0:
            t = docs[rnd.randrange(len(docs))][1] or ""
            t = t[: len(t) // 2] + rnd.choice(["", "#"]) + t[len(t) // 2 :]
        docs.append((i * 3 - 50, t))
    docs += [(900, "a" * 400), (901, "a" * 300 + "b" * 90), (902, "ab" * 90), (903, "a" * 49), (904, None), (905, ""), (906, say(9000)), (907, say(40)), (908, share[0] * 20)]
    docs.append((909, docs[-3][1][100:12000] + "x"))
    return docs


@pytest.mark.parametrize("hot", [50_000, 3])
def test_against_every_string(spark, monkeypatch, hot):
    monkeypatch.setattr(R, "HOT", hot)
    docs = _docs(1, 160)
    rows = docs + [docs[5], docs[5], (None, docs[20][1]), (5000, docs[30][1]), (5000, docs[31][1])]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string").repartition(5)
    want = _brute(docs)
    got = R.remove_repeats(df, "doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in got:
        mine = (bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"])
        if r["doc_id"] in want:
            assert mine == want[r["doc_id"]], r["doc_id"]
        else:
            assert r["n_removed"] == 0 and len(mine[0]) == r["n_bytes"]
    assert R.remove_repeats(df.limit(0), "doc_id", "text").count() == 0


def _run(docs, piece, flush, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(R, "PIECE", piece)
    monkeypatch.setattr(R, "FLUSH", flush)
    batches = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs[k : k + 40]]), pa.array([t for _, t in docs[k : k + 40]])], names=["id", "text"]) for k in range(0, len(docs), 40)]
    decided = pa.Table.from_batches(list(R._first_meet(R._find(1)(iter(batches))))).to_pylist()
    text = {i: (t or "").encode() for i, t in docs}
    runs, wait = {}, []
    for r in decided:
        if r["key"] is None:
            runs.setdefault(r["doc"], []).append((r["a"], r["b"]))
        else:
            p, raw = r["a"], text[r["doc"]]
            s = max(0, p - R.PLACES + 1)
            wait.append((r["key"], r["doc"], p, p - s, raw[s : p + R.LENGTH]))
    wait.sort(key=lambda x: x[0])
    for b in R._compare(iter([R._rows(wait)])):
        for r in b.to_pylist():
            runs.setdefault(r["doc"], []).append((r["a"], r["b"]))
    out = {}
    for i, raw in text.items():
        gone = np.zeros(len(raw) + 2, dtype=np.int8)
        for a, b in runs.get(i, ()):
            assert b <= len(raw)
            gone[a + 1 : b + 1] = 1
        out[i] = (bytes(x for x, g in zip(raw, gone[1:], strict=False) if not g), len(raw), int(gone.sum()), int((np.diff(gone) == 1).sum()))
    return out


def test_one_passage_among_different_neighbours_in_many_documents(spark, monkeypatch):
    """A third of all documents hold one passage with neighbours of their own: its bucket meets in no single task."""
    monkeypatch.setattr(R, "HOT", 20)
    rnd = random.Random(5)
    say = lambda n: "".join(rnd.choice("abcdefghijklmnop ") for _ in range(n))
    passage = say(70)
    docs = [(i, say(80) + (passage if i % 3 == 0 else "") + say(80)) for i in range(300)]
    seen = []
    monkeypatch.setattr(R, "_one_by_one", lambda rows, f=R._one_by_one: seen.append(rows.select("key").distinct().count()) or f(rows))
    got = {r["doc_id"]: (bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in R.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got == _brute(docs) and seen and seen[0] > 0 and sum(g[2] >= 70 for g in got.values()) == 99


def test_small_parts_and_flushes(monkeypatch):
    for seed in (3, 4):
        docs = _docs(seed, 120)
        for piece, flush in ((1000, 200), (400, 10**9)):
            assert _run(docs, piece, flush, monkeypatch) == _brute(docs)
