import random
import re

import pytest

from veritab.operators import blocks


def runs(c):
    """Indexes of the longest rising run by comparing all pairs; ends at the least place, and so on backwards."""
    long, out = [], []
    for i, p in enumerate(c):
        long.append(1 + max((long[j] for j in range(i) if c[j] < p), default=0))
    want, limit, before = max(long, default=0), float("inf"), len(c)
    while want:
        i = min((i for i in range(before) if long[i] == want and c[i] < limit), key=lambda i: c[i])
        out.append(i)
        want, limit, before = want - 1, c[i], i
    return out[::-1]


def brute(a, b, fold):
    """Pieces of two lists of units, by recursion over gaps."""
    close = lambda t: re.sub(r"[ ;.:,]+$", "", t)
    out = []

    def rest(i, j, x, y):
        if x and y:
            out.append(("split" if close(" ".join(map(fold, x))) == close(" ".join(map(fold, y))) else "different", i, len(x), j, len(y)))
        elif x:
            out.append(("lone", i, len(x), None, 0))
        elif y:
            out.append(("lone", None, 0, j, len(y)))

    def gap(i, i2, j, j2):
        x, y = [close(fold(t)) for t in a[i:i2]], [close(fold(t)) for t in b[j:j2]]
        once = [(x.index(t), y.index(t)) for t in x if x.count(t) == 1 and y.count(t) == 1]
        if not once:
            once = sorted((p, q) for p, t in enumerate(x) for q, s in enumerate(y) if t == s and x[:p].count(t) == y[:q].count(t))
        if once:
            kept = [once[k] for k in runs([q for _, q in once])]
            out.extend(("equal", i + p, 1, j + q, 1) for p, q in kept)
            for (p, q), (p2, q2) in zip([(-1, -1), *kept], [*kept, (i2 - i, j2 - j)], strict=True):
                gap(i + p + 1, i + p2, j + q + 1, j + q2)
            return
        found = []
        for one, many, o, m, side in ((y, a[i:i2], j, i, 0), (x, b[j:j2], i, j, 1)):
            forms, seen, ones = {}, {}, {}
            for p in range(len(many)):
                for k in (2, 3, 4):
                    if p + k <= len(many) and (f := close(" ".join(map(fold, many[p : p + k])))):
                        forms.setdefault(f, []).append((p, k))
            for q, t in enumerate(one):
                ones.setdefault(t, []).append(q)
            for f, r in forms.items():
                for (p, k), q in zip(r, ones.get(f, []), strict=False):
                    found.append((p, k, q, 1) if side == 0 else (q, 1, p, k))
        p0 = q0 = 0
        for p, n, q, m in sorted(found):
            if p >= p0 and q >= q0:
                rest(i + p0, j + q0, a[i + p0 : i + p], b[j + q0 : j + q])
                out.append(("split", i + p, n, j + q, m))
                p0, q0 = p + n, q + m
        rest(i + p0, j + q0, a[i + p0 : i2], b[j + q0 : j2])

    gap(0, len(a), 0, len(b))
    return sorted(out, key=repr)


def units(spark, pairs):
    rows = [(k, s, i, t, t.lower()) for k, (a, b) in enumerate(pairs) for s, side in enumerate((a, b)) for i, t in enumerate(side)]
    return spark.createDataFrame(rows, "pair long, side int, pos int, text string, folded string")


def check(spark, pairs):
    got = {}
    for r in blocks.classes(units(spark, pairs)).collect():
        got.setdefault(r.pair, []).append((r["class"], r.a, r.na, r.b, r.nb))
        a, b = pairs[r.pair]
        assert r.left == (None if r.a is None else " ".join(a[r.a : r.a + r.na])) and r.right == (None if r.b is None else " ".join(b[r.b : r.b + r.nb]))
    for k, (a, b) in enumerate(pairs):
        assert sorted(got.get(k, []), key=repr) == brute(a, b, str.lower), (a, b)


def test_classes_against_recursion(spark):
    r = random.Random(4)
    pairs = [([], []), (["a"], []), ([], ["b"]), (["A;"], ["a."]), (["one two"], ["One", "two."]), (["a", "b", "c", "d", "e"], ["a b c d e"])]
    for n in range(60):
        words = ["a", "B.", "c d", "c", "d", "a c", "", "a B. c", "x;"][: 2 + n % 8]
        pairs.append(([r.choice(words) for _ in range(r.randrange(14))], [r.choice(words) for _ in range(r.randrange(14))]))
    for _ in range(20):
        a = [f"w{r.randrange(200)}" for _ in range(60)]
        b = [x for x in a if r.random() < 0.8]
        r.shuffle(moved := b[10:20])
        pairs.append((a, b[:10] + moved + [" ".join(b[20:23])] + b[23:]))
    check(spark, pairs)


def test_modes(spark):
    rows = [(1, "equal", "a {{v:x}}"), (1, "equal", "a"), (2, "equal", "a"), (2, "lone", "b"), (3, "lone", "{{v:y}}"), (4, "equal", "mail a@b.pt"), (5, "different", "{{v:y}}"), (6, "split", "a")]
    df = spark.createDataFrame(rows, "pair int, class string, left string")
    got = {(r.pair, r.left): (r["mode"], r.block_mode) for r in blocks.modes(df, df.left.contains("{{v:"), df.left.contains("@")).collect()}
    assert got[1, "a {{v:x}}"] == ("parametric", "parametric") and got[1, "a"] == ("fixed", "parametric")
    assert got[2, "b"] == ("adaptive", "adaptive") and got[3, "{{v:y}}"][0] == "parametric"
    assert got[4, "mail a@b.pt"][0] == "adaptive" and got[5, "{{v:y}}"][0] == "adaptive" and got[6, "a"] == ("fixed", "fixed")


def test_empty(spark):
    empty = units(spark, [])
    assert blocks.classes(empty.withColumn("class", empty.pos)).collect() == []


def test_neighbouring_turns(spark):
    """The query over its whole table."""
    from pyspark.sql import functions as F

    from veritab.functions.text import _bare
    from veritab.plans.texts import aligned_turns

    sf = "/root/testdata/sf0.001"
    by = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn", "role", "text").collect():
        by.setdefault(r.conv_id, []).append(r)
    got = {}
    for r in aligned_turns(spark, sf).select("pair", F.col("class").alias("c"), "a", "na", "b", "nb").collect():
        got.setdefault(r.pair, []).append((r.c, r.a, r.na, r.b, r.nb))
    n = 0
    for rows in by.values():
        for x, y in zip(rows, rows[1:], strict=False):
            n += 1
            assert sorted(got[f"{x.conv_id}:{x.turn}:{x.role}"], key=repr) == brute(x.text.split(), y.text.split(), lambda t: " ".join(_bare(t).split()))
    assert n == len(got) > 50


@pytest.mark.parametrize("places", [[], [1], [3, 1, 2, 5, 4], [2, 2, 1], list(range(9, 0, -1))])
def test_longest_run(places):
    assert blocks.longest_run(places) == runs(places)


def test_rounds_exchange_nothing(spark):
    """What is left to do once the gaps are written is narrow: disk stays near the input's size."""
    out = blocks.classes(units(spark, [(["a", "x", "b"], ["a", "y", "b"])]))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["class"] for r in out.collect()) == ["different", "equal", "equal"]
