import random
import re

from veritab.operators import links, merge


def score(a, b):
    return 0 if not a or not b else 2 if a == b else 1 if a.startswith(b) or b.startswith(a) else 0


def best(left, right, fits):
    """Best rows of each left id by comparing all pairs; rows are (scope, id, names...)."""
    out, by = set(), {}
    for x in set(left):
        for y in set(right):
            if x[0] is not None and x[0] == y[0] and (s := fits(x[2:], y[2:])):
                by.setdefault(x[1], set()).add((s, y[1], x[2:], y[2:]))
    for k, met in by.items():
        top = [m for m in met if m[0] == max(met)[0]]
        out |= {(k, m[1], m[0], len(top) == 1) for m in top}
    return out


def narrow(df):
    """No window and no exchange stands over the join that makes pairs of rows."""
    return re.search(r"Window|Exchange|Join", df._jdf.queryExecution().executedPlan().toString())[0] == "Join"


def rows(r, n, names):
    out = [(r.choice([1, 2, 3, None]), i, *[r.choice(["", "A", "AB", "ABC", "B", "BC", "C1", None]) for _ in range(names)]) for i in range(n)]
    return out + out[:5]  # repeated rows


def test_best_matches(spark):
    r = random.Random(3)
    for n, m in ((30, 25), (3, 40), (5, 0)):
        left, right = rows(r, n, 1), rows(r, m, 1)
        a = spark.createDataFrame(left, "s int, l int, x string")
        b = spark.createDataFrame(right, "s int, r int, y string")
        got = merge.best_matches(a, b, "s", "l", "r", "x", "y")
        assert narrow(got)
        assert sorted(map(tuple, got.collect())) == sorted(best(left, right, lambda p, q: score(p[0], q[0])))


def test_best_by_both_ends(spark):
    r = random.Random(5)
    for n, m in ((40, 30), (4, 60), (5, 0)):
        left, right = rows(r, n, 2), rows(r, m, 2)
        a = spark.createDataFrame(left, "s int, l int, origin string, destination string")
        b = spark.createDataFrame(right, "s int, r int, origin string, destination string")
        got = links.best_by_both_ends(a, b, "s", "l", "r")
        fits = lambda p, q: (f + s) if (f := score(p[0], q[0])) and (s := score(p[1], q[1])) else 0
        assert narrow(got)
        assert sorted(map(tuple, got.collect())) == sorted(best(left, right, fits))
