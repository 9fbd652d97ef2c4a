import collections
import math
import random

from veritab.llm import decontaminate as D


def _sh(w):
    k = min(5, len(w))
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if w else []


def _brute(docs, items):
    sh = {i: _sh((t or "").lower().split()) for i, t in items if (t or "").split()}
    df = collections.Counter(h for s in sh.values() for h in set(s))
    wt = lambda h: 1 + math.log((1 + len(sh)) / (1 + df[h]))
    out = {}
    for d, t in docs:
        w = (t or "").lower().split()
        for i, s in sh.items():
            n = len(s) + min(5, len(s[0])) - 1
            want = collections.Counter(s)
            k = len(s[0])
            if not set(s) & {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}:
                continue  # nothing shared in any window
            for at in range(max(1, len(w) - n + 1)):
                win = w[at : at + n]
                have = collections.Counter(tuple(win[j : j + k]) for j in range(len(win) - k + 1))
                if sum(min(c, have[h]) * wt(h) for h, c in want.items()) >= 0.8 * sum(c * wt(h) for h, c in want.items()) - 1e-9:
                    out.setdefault(d, set()).add(i)
    return out


def test_against_all_windows(spark):
    rnd = random.Random(8)
    voc = ["".join(rnd.choice("abcdefg") for _ in range(4)) for _ in range(300)]
    say = lambda n: [rnd.choice(voc) for _ in range(n)]
    base = [say(n) for n in (1, 3, 5, 6, 20, 33, 33, 48, 60)]
    base[6] = base[5][:20] + say(13)
    items = [(i, " ".join(w)) for i, w in enumerate(base)] + [(50, None), (51, " "), (52, " ".join(base[4])), (None, "qqqq rrrr")]
    docs = [(0, None), (1, ""), (2, "one two"), (3, " ".join(base[4]).upper())]
    for d in range(4, 90):
        w = list(base[rnd.randrange(2, 9)])
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = rnd.choice(voc)
        if d % 5 == 0:
            del w[rnd.randrange(len(w))]
        docs.append((d, " ".join(say(rnd.randrange(80)) + w) + "\n" + " ".join(say(rnd.randrange(80)))))
    docs += [(200, docs[10][1]), (200, docs[10][1]), (None, docs[10][1]), (201, " ".join(say(6000)))]
    df = spark.createDataFrame([(d, t, "i") for d, t in docs], "doc_id long, text string, item string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["text_key"]: set(r["item_ids"]) for r in D.contaminated(df, "text", bench).collect()}
    want = _brute([x for x in docs if x[0] is not None], [x for x in items if x[0] is not None])
    named = df.select("doc_id", D.text_key(df["text"]).alias("k")).collect()
    assert {r["doc_id"]: got[r["k"]] - {None} for r in named if r["doc_id"] is not None and r["k"] in got} == want
    clean = D.clean_rows(df, bench)
    assert clean.columns == df.columns
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs if (10 if d is None else d) not in want}
    assert D.clean_rows(df.limit(0), bench).count() == 0
    assert D.clean_rows(df, bench.limit(0)).count() == len(docs)


def test_common_templates_with_light_edits(spark):
    """Items of one template: their shingles weigh little, the edits in a window much."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    plate = [word() for _ in range(24)]
    items = [(i, " ".join(plate)) for i in range(60)] + [(100 + i, " ".join(word() for _ in range(24))) for i in range(20)]
    docs = [(d, " ".join([word() for _ in range(30)] + plate[:20] + [word() for _ in range(34)])) for d in range(60)]  # 16 of 20 shingles
    docs += [(100 + d, " ".join([word() for _ in range(30)] + plate[:19] + [word() for _ in range(35)])) for d in range(20)]  # 15 of 20
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["text_key"]: r["item_ids"] for r in D.contaminated(df, "text", spark.createDataFrame(items, "item_id long, text string")).collect()}
    named = {r["doc_id"]: got.get(r["k"]) for r in df.select("doc_id", D.text_key(df["text"]).alias("k")).collect()}
    assert {d: ids for d, ids in named.items() if ids} == {d: list(range(60)) for d in range(60)}


def test_windows_between_two_alignments(spark):
    """Two words put into an item: the best window starts at neither alignment's own place."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    head, tail = [word() for _ in range(5)], [word() for _ in range(5)]
    base = [[*head, *[word() for _ in range(20)], *tail] for _ in range(20)]
    items = [(i, " ".join(w)) for i, w in enumerate(base)]
    docs = []
    for d in range(200):
        w = list(base[d % 20])
        at = rnd.randrange(6, 25)
        w[at:at] = [word() for _ in range(1 + d % 3)]
        docs.append((d, " ".join([word() for _ in range(rnd.randrange(40))] + w + [word() for _ in range(rnd.randrange(40))])))
    docs.append((500, " ".join(" ".join(base[3]) for _ in range(300))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["text_key"]: set(r["item_ids"]) for r in D.contaminated(df, "text", spark.createDataFrame(items, "item_id long, text string")).collect()}
    named = df.select("doc_id", D.text_key(df["text"]).alias("k")).collect()
    want = _brute(docs, items)
    assert len(want) > 40 and {r["doc_id"]: got[r["k"]] for r in named if r["k"] in got} == want
