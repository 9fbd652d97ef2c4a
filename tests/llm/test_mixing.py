import re

from veritab.llm.mixing import mix


def _targets(sizes, cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    fixed, free, total = {}, set(names), sum(sizes.values())
    while free:
        share = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > cap * sizes[s]}
        if not over:
            return fixed | {s: share * weight[s] for s in free}
        fixed |= {s: cap * sizes[s] for s in over}
        free -= over
    return fixed


def test_against_the_loop(spark):
    rows = [(i, "w " * (i % 11), f"s{i % 7}" if i % 13 else None, 1) for i in range(800)]
    rows += [(9000 + i, "a b c", "tiny", 1) for i in range(3)] + [(None, None, "none", 1), (9100, "x y", "tiny", 1), (9100, "x y", "tiny", 1), (9200, "z " * 4000, "s1", 1)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string, target long"), "doc_id", "text", "source").collect()
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"\S+", t or ""))
    want = _targets(sizes)
    taken = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_empty(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string"), "doc_id", "text", "source").collect() == []
