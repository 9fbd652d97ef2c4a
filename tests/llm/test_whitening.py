import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veritab.llm import whitening


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 24), st.integers(0, 10_000), st.integers(0, 3))
def test_symmetric_qr(d, seed, kind):
    r = np.random.default_rng(seed)
    a = r.normal(size=(d, d))
    if kind == 1:  # few distinct eigenvalues
        q = np.linalg.qr(a)[0]
        a = q @ np.diag(r.integers(0, 3, d).astype(float)) @ q.T
    elif kind == 2:
        a = np.diag(r.integers(-2, 3, d).astype(float))
    elif kind == 3:
        a *= 1e200
    a = (a + a.T) / 2
    values, rows = whitening.symmetric_qr(a)
    size = max(1e-300, np.abs(a).max())
    assert np.allclose(values / size, np.linalg.eigvalsh(a / size)[::-1], atol=1e-12 * d)
    assert np.allclose(rows @ rows.T, np.eye(d), atol=1e-12)
    assert np.allclose(rows.T @ np.diag(values / size) @ rows, a / size, atol=1e-12 * d)


def test_streamed_and_merged_moments():
    r = np.random.default_rng(1)
    x = r.integers(-70, 70, (500, 6)) + 1_000_000
    parts = []
    for rows in (x[:1], x[1:17], x[17:]):
        n, mean, m2 = 0, np.zeros(6), np.zeros((6, 6))
        for v in rows.astype(float):
            n = whitening.add_one(n, mean, m2, v)
        parts.append(whitening.Moments(n, whitening._int_sums(rows), mean, m2))
    m = whitening.merge(whitening.merge(parts[0], parts[1]), parts[2])
    apart = x - x.mean(0)
    assert m.n == 500 and m.sums == x.sum(0).tolist()
    assert np.allclose(m.m2, apart.T @ apart, rtol=1e-9, atol=1e-6)


def brute(rows, components=16):
    """{id: (n, deviation, |whitened| ..., explained ...)} with numpy and Python's integers."""
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = {i: tuple(math.floor(64 * c) + 1_000_000 for c in v) for i, v in rows}
    fit = sorted(set(x.values()))
    n, d = len(fit), len(fit[0])
    sums = [sum(v[j] for v in fit) for j in range(d)]
    apart = np.array([[(n * v[j] - sums[j]) / n for j in range(d)] for v in fit])
    values, vectors = np.linalg.eigh(apart.T @ apart / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, d)
    own = {i: np.array([(n * v[j] - sums[j]) / n for j in range(d)]) @ vectors[:, :k] / np.sqrt(values[:k]) for i, v in x.items()}
    return n, {i: sum((n * v[j] - sums[j]) ** 2 for j in range(d)) for i, v in x.items()}, own, values[:k] / values.sum()


def check(spark, rows, out):
    n, deviation, own, explained = brute(rows)
    got = {}
    for r in out.collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert set(got) == set(own)
    ids = sorted(own)
    for c in range(1, len(explained) + 1):
        a, b = np.array([got[i][c].whitened for i in ids]), np.array([own[i][c - 1] for i in ids])
        assert np.allclose(a, b, atol=1e-7) or np.allclose(a, -b, atol=1e-7)
        assert all(got[i][c].n == n and got[i][c].deviation == deviation[i] for i in ids)
        assert abs(got[ids[0]][c].explained / explained[c - 1] - 1) < 1e-9 and got[ids[0]][c].identity_error < 1e-8


def test_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    check(spark, rows, whitening.op12_welford_whitening(spark, "/root/testdata/sf0.001"))


def test_many_partitions_copies_and_odd_rows(spark):
    r = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(r.normal(size=(400, 5)).tolist())]
    rows += [(1_000 + i, rows[0][1]) for i in range(300)]
    odd = [(-1, None), (-2, [1.0, None, 0.0, 0.0, 0.0]), (-3, [float("nan")] * 5), (-4, [float("inf")] * 5), (-5, [1.0, 2.0]), (-6, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + odd], "vec_id long, `a.vec` array<double>, x string, n int").repartition(40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        check(spark, rows, whitening.whitened(df, "vec_id", "a.vec"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_edges(spark):
    make = lambda rows: whitening.whitened(spark.createDataFrame(rows, "`v.id` string, vec array<float>"), "v.id", "vec").collect()
    assert make([]) == [] and make([("a", None), ("b", [])]) == []
    one = make([("a", [1.0, 2.0]), (None, [1.0, 2.0])])  # no variance at all
    assert len(one) == 4 and all(r.whitened is None and r.deviation == 0 and r.n == 1 and r.identity_error == 0 for r in one)
    flat = make([("a", [1.0, 0.0]), ("b", [-1.0, 0.0])])  # variance along one component
    assert [abs(r.whitened) for r in flat if r.component == 1] == pytest.approx([1, 1])
    assert [r.whitened for r in flat if r.component == 2] == [None, None]
    huge = make([("a", [3e38, 1.0]), ("b", [-3e38, 0.0]), ("c", [0.5, 0.25])])
    assert all(r.deviation is None or r.deviation >= 0 for r in huge) and len(huge) == 6
