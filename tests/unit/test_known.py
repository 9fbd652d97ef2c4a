import random
import re
import unicodedata

import pyarrow as pa
import pytest

from veritab.operators import known


def slow_fold(text):
    out, at, before = "", [], False
    for i, c in enumerate(text):
        if c == "_" or c.isspace():
            if not before:
                out, at = out + " ", [*at, i]
            before = True
            continue
        before = False
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).casefold() or c
        out, at = out + base, at + [i] * len(base)
    return out, [*at, len(text)]


def brute(text, values, detectors, kept=(), allowed=()):
    """All values at all places, one after the other."""
    low, at = slow_fold(text)
    alnum = "0123456789abcdefghijklmnopqrstuvwxyz"
    kinds = {}
    for k, v in values:
        f = slow_fold(v)[0].strip()
        if len(f) >= known.LEAST:
            kinds[f] = min(k, kinds.get(f, k))
    out, taken, i = [], [], 0
    while i < len(low):
        best = max((f for f in kinds if low.startswith(f, i) and not (i and low[i - 1] in alnum) and not low[i + len(f) : i + len(f) + 1] in tuple(alnum)), key=len, default=None)
        if best and all(at[i] >= b for _, b in taken):
            a, b = at[i], at[i + len(best) - 1] + 1
            taken.append((a, b))
            out.append((a, b, kinds[best], "known", text[a:b]))
        i += 1
    for k, p in detectors.items():
        for m in re.finditer(p, text):
            a, b = m.span()
            if a < b and all(b <= c or a >= d for c, d in taken):
                taken.append((a, b))
                if k not in kept and (k, slow_fold(text[a:b])[0].strip()) not in {(x, slow_fold(y)[0].strip()) for x, y in allowed}:
                    out.append((a, b, k, "pattern", text[a:b]))
    return sorted(out)


DETECT = {"mail": r"[\w.]+@[\w.]+", "number": r"[0-9]{3,}", "word": r"\bx[a-z]+\b"}


def samples(seed):
    r = random.Random(seed)
    words = ["Ana", "ANÁ", "Silva", "de", "ß", "ﬁm", "x@y.pt", "12345", "123", "João", "joao", "Straße", "strasse", "__", "´", "¨", "日本", "xab", "a", "𝔄", "é"]
    gaps = [" ", "  ", "_", "\n", " ", "", ".", "-", "\x1f"]
    return ["".join(r.choice(words) + r.choice(gaps) for _ in range(r.randrange(40))) for _ in range(150)]


VALUES = [("name", "Ana Silva"), ("name", "ana  silva de joão"), ("place", "Straße"), ("place", "ANA"), ("name", "João Silva"), ("mail", "x@y.pt"), ("place", "x@y.pt"), ("a", "joao"), ("z", "  "), ("z", "ab"), ("n", "123 123"), (None, "x"), ("n", None), ("f", "ﬁm de"), ("k", "日本 a a")]


def test_fold_map():
    for t in [*samples(1), "", "¨", "́", "  a", "ßß", "İi"]:
        low, at = known.fold_map(t)
        assert (low, at.tolist()) == slow_fold(t)


@pytest.mark.parametrize("most", [1_000, 3])
def test_spans_against_brute_force(spark, most):
    texts = [*samples(2), None, "", "ana silva"]
    df = spark.createDataFrame([(i if i % 9 else None, t, "q") for i, t in enumerate(texts)], "`the id` long, `a text` string, kind string").repartition(5)
    values = spark.createDataFrame(VALUES, "kind string, value string")
    kept, allowed = ["mail"], [("number", "12345")]
    got = known.personal_spans(df, "the id", "a text", values, DETECT, kept, allowed, most).collect()
    good = [(k, v) for k, v in VALUES if k and v]
    want = [((i if i % 9 else None), *x) for i, t in enumerate(texts) for x in brute(t or "", good, DETECT, kept, allowed)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(want) > 300


def test_no_values_and_no_rows(spark):
    none = spark.createDataFrame([], "kind string, value string")
    df = spark.createDataFrame([(1, "123 a")], "id int, text string")
    assert [tuple(r) for r in known.personal_spans(df, "id", "text", none, DETECT).collect()] == [(1, 0, 3, "number", "pattern", "123")]
    assert known.personal_spans(df.filter("id = 2"), "id", "text", none, {}).collect() == []
    assert known.personal_spans(df, "id", "text", none, {}, most=-1).collect() == []


def test_long_text_with_many_hits():
    import time

    text, a = "Ana Silva, 12345; " * 100_000, known.automaton([("ana silva", "name")])
    began = time.time()
    assert len(known.places(text, a, [("n", re.compile(r"[0-9]+"))])) == 200_000
    assert time.time() - began < 20


def test_beginnings_that_no_value_has_are_not_exchanged(spark):
    gram = spark.createDataFrame([("joao silva",), ("日本 a",), ("x",)], "gram string")
    run = known._grams([1, 4, 10], spark.sparkContext.broadcast(known._bits(gram)))
    texts = pa.RecordBatch.from_arrays([pa.array(["k"]), pa.array(["João Silva viu 日本 a, " + " ".join(map(str, range(2_000)))])], names=["key", "text"])
    found = [g for b in run(iter([texts])) for g in b.column(1).to_pylist()]
    assert {"joao silva", "日本 a"} <= set(found) and len(found) < 5


def raw(text, values, table=known.Table):
    """What a table and an automaton find."""
    low = known.fold_map(text)[0]
    kinds = {known.folded(v): k for k, v in values}
    return sorted(table(list(kinds), list(kinds.values())).hits(low)), sorted(known._automaton_hits(low, known.automaton(kinds.items())))


class SameHashes(known.Table):
    """Hashes of one bit."""

    _hash = staticmethod(lambda sums, start, stop: known.Table._hash(sums, start, stop) & known.np.uint64(1 << 63))


@pytest.mark.parametrize("table", [known.Table, SameHashes])
def test_table_finds_what_an_automaton_finds(table):
    r, found = random.Random(3), 0
    for text in samples(4):
        parts = [text[i : i + n] for i, n in ((r.randrange(len(text) + 1), r.choice([5, 9, 70, 120, 200])) for _ in range(30))]
        got, want = raw(text, [("a", p) for p in parts if len(known.folded(p)) >= known.LEAST] + [("b", "ana silva")], table)
        found += len(got)
        assert got == want
    assert found > 200 and max(-x[1] for x in raw("a" * 90 + " b", [("k", "a" * 90)])[0]) == 90  # longer than NEAR


def test_folds_of_a_batch():
    for t in (samples(5), ["a\0B", "", " _"], [""], []):
        assert known.folded_all(t) == [known.folded(x) for x in t]


def test_many_values_are_searched_for_without_an_exchange_of_texts(spark, monkeypatch):
    """More values than an automaton was sent for: texts and what stands in them are not dealt by it."""
    monkeypatch.setattr(known, "_grams", None)
    values = spark.range(250_000).selectExpr("'k' as kind", "concat('wert ', id) as value")
    df = spark.createDataFrame([(1, "Wert 249999, WERT_7 und wert 250000")], "id int, text string")
    out = known.personal_spans(df, "id", "text", values, {})
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(r.start, r.stop) for r in out.orderBy("start").collect()] == [(0, 11), (13, 19)]


def test_detectors_beside_many_values(spark, monkeypatch):
    monkeypatch.setattr(known, "_grams", None)
    values = spark.range(250_000).selectExpr("'k' as kind", "concat('wert ', id, '@y.pt') as value")
    df = spark.createDataFrame([(1, "WERT  9@y.pt, 777 w@y.pt"), (2, None)], "id int, text string")
    out = known.personal_spans(df, "id", "text", values, DETECT, ["number"])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.start, r.stop, r.kind, r.source) for r in out.collect()) == [(1, 0, 12, "k", "known"), (1, 18, 24, "mail", "pattern")]
