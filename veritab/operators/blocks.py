"""Two versions of a text, unit by unit: anchors cut gaps, gaps are aligned again in rounds, the rest is classed."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.sources.stage import dropped, saved

#: Units that one unit of the other side may be split into.
SPLIT = (2, 3, 4)
#: What closes a unit without being part of it.
CLOSING = r"[ ;.:,]+$"


def _places(*names: str) -> T.DataType:
    return T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in names]))


def longest_run(places: list[int]) -> list[int]:
    """Indexes of a longest rising run; of several the one whose last place is least, and so on backwards."""
    tops, at, back = [], [], []
    for i, p in enumerate(places):
        k = bisect_left(tops, p)
        back.append(at[k - 1] if k else -1)
        tops[k : k + 1], at[k : k + 1] = [p], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


#: CLOSING as Spark reads it: an end may be followed by one line end.
_CLOSING = re.compile(CLOSING[:-1] + r"(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)")


def anchors(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """The longest run of units that stand once on either side; if there are none, of equal ones by their occurrence."""
    left, right = Counter(x), Counter(y)
    once = {t: [q] for q, t in enumerate(y) if left[t] == right[t] == 1}
    places: dict[str, list[int]] = once or {}
    if not once:
        for q, t in enumerate(y):
            places.setdefault(t, []).append(q)
    met, seen = [], Counter()
    for p, t in enumerate(x):
        if seen[t] < len(places.get(t, ())):
            met.append((p, places[t][seen[t]]))
            seen[t] += 1
    return [met[i] for i in longest_run([q for _, q in met])]


def splits(x: list[str], y: list[str]) -> list[tuple[int, int, int, int]]:
    """(a, na, b, nb), in order: units of one side that are the joined text of 2 to 4 units of the other."""
    found = []
    for many, one, turned in ((x, y, False), (y, x, True)):
        places: dict[str, list[int]] = {}
        for q, t in enumerate(one):
            if t := _CLOSING.sub("", t):
                places.setdefault(t, []).append(q)
        seen: Counter[str] = Counter()
        for p in range(len(many)):
            for n in SPLIT:
                t = _CLOSING.sub("", " ".join(many[p : p + n]))
                if p + n <= len(many) and seen[t] < len(places.get(t, ())):
                    q = places[t][seen[t]]
                    seen[t] += 1
                    found.append((q, 1, p, n) if turned else (p, n, q, 1))
    out, a, b = [], 0, 0
    for p in sorted(found):
        if p[0] >= a and p[2] >= b:
            out.append(p)
            a, b = p[0] + p[1], p[2] + p[3]
    return out


@F.pandas_udf(_places("a", "na", "b", "nb"))
def _anchored(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([[(p, 1, q, 1) for p, q in anchors(list(i), list(j))] for i, j in zip(x, y, strict=True)])


@F.pandas_udf(_places("a", "na", "b", "nb"))
def _split(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([splits(list(i), list(j)) if len(i) and len(j) else [] for i, j in zip(x, y, strict=True)])


#: The units of both sides in a stretch: their texts, and as they are compared.
_SIDES = ("xt", "xf", "yt", "yf")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("met", T.BooleanType()), *[T.StructField(n, T.IntegerType()) for n in "ab"], *[T.StructField(n, T.ArrayType(T.StringType())) for n in _SIDES]])))
def _pieces(cuts: pd.Series, a: pd.Series, b: pd.Series, xt: pd.Series, xf: pd.Series, yt: pd.Series, yf: pd.Series) -> pd.Series:
    """A stretch cut at ``cuts``: these (met), and the gaps before, between and behind them that hold units."""

    def one(cuts, a0, b0, xt, xf, yt, yf):
        out, a, b = [], 0, 0
        for c in [*cuts, {"a": len(xt), "na": 0, "b": len(yt), "nb": 0}]:
            for met, p, p2, q, q2 in ((False, a, c["a"], b, c["b"]), (True, c["a"], c["a"] + c["na"], c["b"], c["b"] + c["nb"])):
                if p < p2 or q < q2:
                    out.append((met, a0 + p, b0 + q, xt[p:p2], xf[p:p2], yt[q:q2], yf[q:q2]))
            a, b = c["a"] + c["na"], c["b"] + c["nb"]
        return out

    return pd.Series([one(*r) for r in zip(cuts, a, b, xt, xf, yt, yf, strict=True)])


def _cut(gaps: DataFrame, kept: tuple[str, ...] = ("pair",)) -> DataFrame:
    return gaps.select(*kept, F.explode(_pieces("cuts", "a", "b", *_SIDES)).alias("p")).select(*kept, "p.*")


def classes(units: DataFrame) -> DataFrame:
    """:func:`aligned` of units as rows: pair, side (0 or 1), pos (0, 1, ... on each side), text and folded.

    Null texts and folded texts count as empty. Rows with a null pair are left out.
    """
    u = units.filter("pair is not null").select("pair", "side", F.struct(F.col("pos").cast("int"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("folded", F.lit("")).alias("folded")).alias("u"))
    of = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("u"))))
    g = u.groupBy("pair").agg(of(0).alias("x"), of(1).alias("y"))
    return aligned(g.select("pair", F.col("x.text").alias("xt"), F.col("x.folded").alias("xf"), F.col("y.text").alias("yt"), F.col("y.folded").alias("yf")))


def aligned(lists: DataFrame) -> DataFrame:
    """(pair, class, a, na, b, nb, left, right) of two versions of a text.

    ``lists`` has a row for each pair: its units on the left (``xt``, and ``xf`` as they are compared) and on the
    right (``yt``, ``yf``), no nulls among them. Units that stand once on both sides of a gap meet by their text; the
    longest run of them in the order of both sides is kept (patience), what lies between two of them is a gap of the
    next round, until no gap has a text on both sides. Then units that equal 2 to 4 joined units of the other side are
    ``split``, and of what is left between, whole gaps of equal joined text are ``split`` too, others ``different`` if
    both sides have units and ``lone`` if one has. ``a``, ``b`` are first places (null where a side has none) and
    ``na``, ``nb`` numbers of units.

    An empty unit equals an empty one and is never part of a split alone. A gap is a row with its units, so that
    rounds exchange nothing; each writes the gaps that it cuts, once, to the shared folder. A pair must fit a task.
    """
    norm = lambda c: F.transform(c, lambda x: F.regexp_replace(x, CLOSING, ""))
    meets = F.arrays_overlap(norm("xf"), norm("yf"))
    start = lists.filter("pair is not null").select("pair", F.lit(0).alias("a"), F.lit(0).alias("b"), *_SIDES)
    now, rounds = saved(start.withColumn("cuts", _anchored(norm("xf"), norm("yf"))), "gaps"), []
    while True:
        rounds.append(now)
        now = saved(_cut(now.filter(F.size("cuts") > 0)).filter(~F.col("met") & meets).drop("met").withColumn("cuts", _anchored(norm("xf"), norm("yf"))), "gaps")
        if now.isEmpty():
            dropped(now)
            break
    ends = reduce(DataFrame.unionByName, [_cut(r) for r in rounds]).filter(F.col("met") | ~meets).withColumnRenamed("met", "same")
    p = _cut(ends.withColumn("cuts", _split("xf", "yf")), ("pair", "same"))
    form = lambda c: F.regexp_replace(F.array_join(c, " "), CLOSING, "")
    one = (F.size("xt") == 0) | (F.size("yt") == 0)
    kind = F.when(F.col("same"), "equal").when(F.col("met"), "split").when(one, "lone").when(form("xf") == form("yf"), "split").otherwise("different")
    has = lambda c, v: F.when(F.size(c) > 0, v)
    return p.select("pair", kind.alias("class"), has("xt", F.col("a")).alias("a"), F.size("xt").alias("na"), has("yt", F.col("b")).alias("b"), F.size("yt").alias("nb"), has("xt", F.array_join("xt", " ")).alias("left"), has("yt", F.array_join("yt", " ")).alias("right"))


def modes(pieces: DataFrame, keys: Column, personal: Column) -> DataFrame:
    """``pieces`` with their mode, and the mode of their block.

    What both versions share is fixed, or parametric if it holds a placeholder (``keys``); what differs is adaptive,
    and so is whatever holds personal data and what one version alone has, unless it holds a placeholder. The block
    takes the strongest of its pieces.
    """
    shared = F.col("class").isin("equal", "split")
    mode = F.when(personal | (F.col("class") == "different"), 2).when(keys, 1).when(shared, 0).otherwise(2)
    name = lambda c: F.element_at(F.array(F.lit("fixed"), F.lit("parametric"), F.lit("adaptive")), c + 1)
    out = pieces.withColumn("_m", mode)
    return out.withColumn("mode", name(F.col("_m"))).withColumn("block_mode", name(F.max("_m").over(Window.partitionBy("pair")))).drop("_m")
