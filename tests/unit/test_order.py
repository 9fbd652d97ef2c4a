import random

from veritab.operators.order import merged_keys


def brute(lists):
    seen, net = {}, {}
    for n, keys in enumerate(lists):
        own = list(dict.fromkeys(keys))
        for p, k in enumerate(keys):
            seen.setdefault(k, (n, p))
        for a, b in zip(own, own[1:], strict=False):
            net[a, b] = net.get((a, b), 0) + 1
    before = {(a, b): w - net.get((b, a), 0) for (a, b), w in net.items() if w > net.get((b, a), 0)}
    left, out, level = set(seen), [], 0
    while left:
        w = {k: sum(v for (a, b), v in before.items() if b == k and a in left) for k in left}
        free = [k for k in left if not w[k]] or [min(left, key=lambda k: (w[k], seen[k], k))]
        for k in sorted(free, key=lambda k: (seen[k], k)):
            out.append((k, level, len(out)))
        left -= set(free)
        level += 1
    return out


def check(spark, lists):
    rows = [(n, p, k, "x") for n, keys in enumerate(lists) for p, k in enumerate(keys)]
    got = merged_keys(spark.createDataFrame(rows, "list int, pos int, key string, level string").drop("level")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[2]) == brute(lists)
    return [r[0] for r in sorted(got, key=lambda r: r[2])]


def test_order_of_agreeing_lists(spark):
    assert check(spark, [["capa", "intro", "normas", "fim"], ["capa", "normas", "rpc", "fim"]]) == ["capa", "intro", "normas", "rpc", "fim"]


def test_cycles_majorities_and_repeats(spark):
    r = random.Random(3)
    check(spark, [["a", "b"], ["b", "c"], ["c", "a"]])
    check(spark, [["a", "b", "a", "c"], ["b", "a"], ["b", "a", "d"], ["z"]])
    check(spark, [[r.choice("abcdefg") for _ in range(r.randrange(6))] for _ in range(12)])


def test_empty_and_null(spark):
    df = spark.createDataFrame([(None, 1, "a"), (1, 1, None)], "list int, pos int, key string")
    assert merged_keys(df).collect() == []
    assert merged_keys(df.limit(0)).collect() == []
