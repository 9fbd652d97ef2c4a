import collections
import os

import pytest

import corpus_pipeline as P
from tests.llm.test_decontaminate import _brute as brute_leaks
from tests.llm.test_mixing import _targets
from tests.llm.test_quality import _brute as brute_counts
from tests.llm.test_simhash import _roots
from veritab.llm import simhash
from veritab.llm.common import saved

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    texts = {r["doc_id"]: (r["text"], r["source"]) for r in docs.collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    # too few labels here to certify a cutoff, so the base rule alone rejects
    kept = set()
    for i, (t, _) in texts.items():
        n, *_, rep = brute_counts(t)
        if n >= 50 and 100 * rep <= 50 * n:
            kept.add(i)
    docs = saved(P.quality_rules(spark, docs, SF), "t1")
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == kept

    sets = {i: set(simhash.shingle_set(texts[i][0], 5).tolist()) for i in kept}

    def near(a, b):
        return 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])

    root = _roots(kept, [(a, b) for a in kept for b in kept if a < b and near(a, b)])
    kept = {i for i in kept if root[i] == i}
    docs = saved(P.near_duplicates(spark, docs, SF), "t2")
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == kept

    kept -= set(brute_leaks([(i, texts[i][0]) for i in kept], items))
    docs = saved(P.decontamination(spark, docs, SF), "t3")
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == kept

    sizes = collections.Counter()
    for i in kept:
        sizes[texts[i][1]] += len(texts[i][0].split())
    docs = saved(P.source_weights(spark, docs, SF), "t4")
    times = collections.Counter(r["doc_id"] for r in docs.collect())
    assert docs.columns == columns and set(times) <= kept and max(times.values()) <= 3
    for s, want in _targets(sizes).items():
        mine = {i: len(texts[i][0].split()) for i in kept if texts[i][1] == s}
        assert abs(sum(times[i] * n for i, n in mine.items()) - want) <= 0.5 * max(mine.values()) + 1

    out = P.shards(spark, docs, SF).collect()
    assert collections.Counter(r["doc_id"] for r in out) == times
    slots = collections.defaultdict(list)
    for r in out:
        assert r["text"] == texts[r["doc_id"]][0]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
