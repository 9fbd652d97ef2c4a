import random

from veritab.llm import lines as L


def _brute(docs):
    """{id: (kept, lines, removed, chunks, pairs)}, place after place."""
    cut, gone, seen = {i: L.lines_of(t) for i, t in docs}, {}, {}
    for i, _ in sorted(docs):
        own = L.chunks_of(cut[i])
        assert [x for a, b in own for x in range(a, b)] == list(range(len(cut[i])))
        gone[i] = []
        for a, b in own:
            c = b"".join(cut[i][a:b])
            if b - a >= 2 and c.strip() and seen.setdefault(c, (i, a)) != (i, a):
                gone[i].append((a, b))
    went = {i: {k for a, b in g for k in range(a, b)} for i, g in gone.items()}
    seen, out = {}, {}
    for i, _ in sorted(docs):
        full, pairs = [k for k, x in enumerate(cut[i]) if x.strip()], []
        for a, b in zip(full, full[1:], strict=False):
            first = seen.setdefault((cut[i][a].rstrip(b"\n"), cut[i][b].rstrip(b"\n")), (i, a, b))
            if first != (i, a, b) and not (first[0] == i and a <= first[2]):
                pairs.append((a, b + 1))
        out_lines = went[i] | {k for a, b in pairs for k in range(a, b)}
        out[i] = (b"".join(x for k, x in enumerate(cut[i]) if k not in out_lines).decode(), len(cut[i]), len(out_lines), len(gone[i]), len(pairs))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(6)
    line = lambda: "".join(rnd.choice("abé ") for _ in range(rnd.randrange(12)))
    shared = [[line() for _ in range(rnd.randrange(4, 14))] for _ in range(6)]
    docs = []
    for i in range(120):
        ls = [line() for _ in range(rnd.randrange(10))]
        for _ in range(rnd.randrange(3)):
            ls += rnd.choice(shared) + [line()]
        docs.append((i, "\n".join(ls) + rnd.choice(["", "\n"])))
    docs += [(500, None), (501, ""), (502, "\n"), (503, "\n\n\n\n\n\n"), (504, "x\n" * 3000), (505, docs[3][1])]
    rows = docs + [docs[7], docs[7], (None, docs[8][1])]
    df = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, kept string").repartition(4)
    want = _brute(docs)
    assert sum(w[3] for w in want.values()) > 60
    got = L.drop_repeated_chunks(df, "doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["kept"], r["n_lines"], r["n_removed"], r["n_chunks"], r["n_pairs"]) == want[r["doc_id"]]
        else:
            assert r["n_removed"] == 0 and r["kept"] == docs[8][1]
    assert L.drop_repeated_chunks(df.limit(0), "doc_id", "text").count() == 0


def test_ids_with_several_texts_and_hot_chunks(spark, monkeypatch):
    monkeypatch.setattr(L, "PART", 20)
    passage = "\n".join(f"line {i} of a passage" for i in range(60)) + "\n"
    docs = [(f"d{i:03}", f"start {i}\n{passage}end {i}\n") for i in range(200)]
    docs += [("d000", "another text\n" + passage), ("d300", docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    got = L.drop_repeated_chunks(df, "doc_id", "text").collect()
    assert len(got) == len(docs)
    inner = 60
    assert sum(r["n_removed"] == 0 for r in got if r["doc_id"] == "d000") == 1
    assert all(r["n_removed"] >= inner for r in got if r["doc_id"] != "d000")
    assert next(r for r in got if r["doc_id"] == "d300")["kept"] == ""


def test_passages_of_every_length_go(spark):
    """Of passages of 2 to 40 lines that stand again among other lines, every line goes where it stands later; others stay."""
    rnd = random.Random(8)
    line = lambda: " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(6))
    docs, own = [], {}
    for n in range(2, 41):
        for copy in range(3):
            passage = own.setdefault(n, [line() for _ in range(n)])
            alone = [line() for _ in range(6)]
            docs.append((3 * n + copy, "\n".join(alone[:3] + passage + alone[3:]), n, copy))
    got = {r["doc_id"]: r for r in L.drop_repeated_chunks(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), "doc_id", "text").collect()}
    for i, t, n, copy in docs:
        assert got[i]["n_removed"] == (n if copy else 0)
        assert got[i]["kept"] == (t if not copy else "\n".join(t.split("\n")[:3] + t.split("\n")[3 + n :]))
