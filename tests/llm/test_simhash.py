import random

import xxhash

from veritab.llm import simhash as S
from veritab.llm.graph import components


def _fp(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).encode().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def _roots(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD", 60)
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdeÉZ") for _ in range(4))
    texts = [None, "", "  ", "one", "one two", "ONE two", "a b c"]
    for _ in range(40):
        w = [word() for _ in range(120)]
        for _ in range(12):
            w = list(w)
            w[rnd.randrange(120)] = word()
            texts.append(" ".join(w))
    texts += [texts[9]] * 50
    ids = list(range(100, 100 + len(texts)))
    rnd.shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, texts, ["z"] * len(ids), strict=True)) + [(None, "one", "z"), (ids[0], texts[0], "z")], "doc_id long, text string, component_id string")
    got = S.near_duplicates(df, "doc_id", "text", 3, 2).collect()
    assert len(got) == len(texts) + 2
    fp = dict(zip(ids, map(_fp, texts), strict=True))
    want = _roots(ids, [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    assert len(set(want.values())) < len(ids) - 60
    for r in got:
        if r["doc_id"] is not None:
            assert (r["fingerprint"], r["component_id"]) == (f"{fp[r['doc_id']]:016x}", want[r["doc_id"]])
    assert S.near_duplicates(df.limit(0), "doc_id", "text", 3, 2).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    rows, keep, i = [], set(), 0
    for g in range(60):
        w = [word() for _ in range(150 + g)]
        keep.add(i)
        for c in range(1 + g % 4 * 5):
            v = list(w)
            if c:
                v[rnd.randrange(len(v))] = word()
            rows.append((i, " ".join(v), "x"))
            i += 1
    rows += [(None, "a b", "n"), (None, None, "n"), (9001, "", "e"), (9002, "", "e"), (3, rows[3][1], "x"), (9003, rows[0][1].upper(), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, f0 string")
    got = S.keep_one(df)
    assert got.columns == df.columns
    ids = sorted((r["doc_id"] for r in got.collect()), key=lambda x: (x is None, x))
    assert ids == sorted(keep) + [9001, 9002, None, None]
    assert S.keep_one(df.limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(9)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1080)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5)]
    want = _roots({x for p in pairs for x in p}, pairs)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if k != v}


def test_stage_links_by_exact_jaccard(spark):
    """Pairs just above and just below the bound, which 512 bits cannot tell apart, and a chain over common boilerplate."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(7))
    rows = []
    for g in range(120):
        w = [word() for _ in range(204)]  # 200 shingles; a changed tail of c words leaves 200 - c
        c = (21, 22, 23, 24, 26)[g % 5]  # Jaccard (200 - c) / (200 + c): 0.81, 0.80, 0.79, 0.79, 0.77
        rows += [(1000 * g, " ".join(w)), (1000 * g + 1, " ".join(w[:-c] + [word() for _ in range(c)]))]
    plate = [word() for _ in range(164)]  # 160 of 200 shingles each: Jaccard 2/3
    rows += [(500_000 + i, " ".join(plate + [word() for _ in range(40)])) for i in range(150)]
    short = [(600_000, "a b c d e f g h i"), (600_001, "a b c d e f g h"), (600_002, "a b c d e f g")]
    rows += short

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {i: shingles(t) for i, t in rows}
    near = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert {a % 1000 + b % 1000 for a, b in near if a < 500_000} == {1} and len(near) == 49
    root = _roots(sets, near)
    got = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == {i for i in sets if root[i] == i}


def test_stage_pairs_near_words_in_vantage_point_shards(spark, monkeypatch):
    """Every set with another one within the radius in a word gets a pair, no pair is further apart, and the stage goes that way."""
    monkeypatch.setattr(S, "SHARD", 40)
    rnd = random.Random(7)
    rows = []
    for _ in range(120):
        f = [rnd.getrandbits(64) for _ in range(2)]
        for c in range(rnd.choice([1, 1, 2, 4])):
            g = [f[0] ^ sum(1 << b for b in rnd.sample(range(64), c % 4)), f[1] if c == 2 else rnd.getrandbits(64)]
            rows.append((len(rows).to_bytes(16, "big"), *[x - (1 << 64) if x >> 63 else x for x in g]))
    points = spark.createDataFrame(rows, "k binary, f0 long, f1 long")
    apart = lambda x, y: min(((x[j] ^ y[j]) & (1 << 64) - 1).bit_count() for j in (1, 2))
    want = {x[0] for x in rows for y in rows if x is not y and apart(x, y) <= 2}
    by = {r[0]: r for r in rows}
    got = [(bytes(r["a"]), bytes(r["b"])) for r in S.vantage_pairs(points, 2, 2).collect()]
    assert len(set(got)) == len(got) and all(a < b and apart(by[a], by[b]) <= 2 for a, b in got)
    assert {k for pair in got for k in pair} == want and len(want) > 80

    calls, old = [], S.vantage_pairs
    monkeypatch.setattr(S, "vantage_pairs", lambda *a: calls.append(old(*a).collect()) or old(*a))
    text = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "other words of a third text")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in S.keep_one(docs).collect()) == [1, 3]
    assert len(calls) == 1 and len(calls[0]) == 1
