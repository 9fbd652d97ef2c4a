import zlib

from veritab.llm.sharding import histogram_shards, sharded


def _check(rows, shards, tolerance):
    sizes = [0] * shards
    slots = [[] for _ in range(shards)]
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots)
    mean = sum(sizes) / shards
    assert max(abs(s - mean) for s in sizes) <= mean * tolerance, sizes
    return sizes


def test_even_bytes_hot_group_and_odd_rows(spark):
    texts = [(i, "word " * (i % 37 + 1)) for i in range(2000)]
    texts = [(i, f"{i} {t}") for i, t in texts]
    texts += [(5000 + i, "copy of one text " * 3) for i in range(1000)]  # heavier than a shard
    texts += [(7000 + i, "second group") for i in range(40)]
    texts += [(8000, None), (8000, None), (None, "x"), (8002, ""), (8003, "long " * 300)]
    df = spark.createDataFrame([(i, t, i, "y") for i, t in texts], "doc_id long, text string, shard long, size string")
    rows = histogram_shards(df, "doc_id", "text", shards=8).collect()
    assert len(rows) == len(texts)
    _check(rows, 8, 0.03)
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] not in (None, 8000)}
    for i, t in texts:
        if i not in (None, 8000):
            assert by_id[i]["size"] == len(t.encode()) + 16
            assert by_id[i]["text_crc32"] == zlib.crc32(t.encode())
    assert [(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] == 8000] == [(16, 0)] * 2
    assert len({by_id[7000 + i]["shard"] for i in range(40)}) == 1  # a group that fits stays whole


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert histogram_shards(df, "doc_id", "text").collect() == []


def test_groups_that_would_overfill_a_shard(spark):
    """Nine groups of 0.6 shares for eight shards: whole groups would put two into one."""
    docs = [(100 * g + i, f"group {g} " + "text " * 20) for g in range(9) for i in range(60)]
    docs += [(10_000 + i, f"{i} other " + "words " * 12) for i in range(520)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    _check(histogram_shards(df, "doc_id", "text", shards=8).collect(), 8, 0.03)


def test_whole_documents(spark):
    docs = [(i % 300, f"{i % 300} " + "word " * (i % 11), "x", i % 7) for i in range(900)] + [(None, None, None, 1)] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string, shard string, g int")
    out = sharded(df, shards=4)
    assert out.columns == ["doc_id", "text", "g", "shard", "slot"]
    rows = out.collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "", r["g"]) for r in rows) == sorted((a or -1, b or "", d) for a, b, _, d in docs)
    slots = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(4)}
    assert all(v == list(range(len(v))) for v in slots.values()) and sum(map(len, slots.values())) == 903
    assert sharded(df.limit(0)).count() == 0
