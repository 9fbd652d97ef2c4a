import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veritab.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts(seed):
    r = random.Random(seed)
    parts = ["don't", "'s", "''re", "<|endoftext|>", "<|STARTOFTEXT|>", "1234", "é", "é", "́", "Straße", "😀😀", "日本語", " ", " ", "\x0b", "\x1c", "\x1f", "...", "ΣΑΣ", "İ", "_a_", "ab" * 9, "가", "Å"]
    gaps = [" ", "  ", "\n", "\t", "\r\n", "", "", "   "]
    return ["".join(r.choice(parts) + r.choice(gaps) for _ in range(r.randrange(400))) for _ in range(25)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_add_up_to_the_library_count(name):
    path = public_tokenizers.path(name)
    own, known = Tokenizer.from_file(path), tokens._Words(path)
    for t in texts(1):
        assert known.counts(t) == len(own.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_way_of_counting_equals_the_library(spark, name):
    path = public_tokenizers.path(name)
    own = Tokenizer.from_file(path)
    r = random.Random(2)
    prose = " ".join("".join(r.choice("abcdeé'1.") for _ in range(r.randrange(1, 12))) for _ in range(30_000))
    wide = "x " * 9_000 + "ab" * 1_500 + " y" * 20_000  # one overlap of 256 without a place: the next is wider
    glued = "q" * 70_000 + " end " + prose[:60_000]  # one word longer than chunks
    rows = [(1, prose), (2, wide), (3, glued), (4, "ab1" * 40_000), (5, None), (6, ""), (7, "a <|endoftext|> b"), (7, "a <|endoftext|> b"), (None, prose), (8, prose), (9, "\n" * 60_000), (10, (" <|endoftext|>" * 5_000))]
    rows += [(100 + i, t) for i, t in enumerate(texts(3))]
    got = tokens.token_counts(spark.createDataFrame(rows, "id long, text string"), "id", "text", path, 100).collect()
    want = [(i, len((t or "").encode()), n := len(own.encode(t or "", add_special_tokens=False).ids), n > 100) for i, t in rows]
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_small_chunks_of_awkward_texts(spark, monkeypatch):
    own = Tokenizer.from_file(PATH)
    monkeypatch.setattr(tokens, "CHUNK", 64)
    for t in texts(4):
        for overlap in (8, 32):
            cut = [c.to_pylist()[0] for c in tokens._cut(overlap)(iter([batch(t, [None])]))]
            assert "".join(c["part"][:64] if not c["last"] else c["part"] for c in cut) == t
            done = [c for b in tokens._encode(PATH, overlap)(map(chunk_batch, cut)) for c in b.to_pylist()]
            rows = tokens._spliced(spark.createDataFrame(done, "key string, lo long, hi long, k int, last boolean, n long, head array<struct<p:long,i:long>>, tail array<struct<p:long,i:long>>")).collect()
            assert sum(x.to - x.p for x in rows) == len(t)
            for x in rows:
                if x.n is not None:
                    assert x.n == len(own.encode(t[x.p : x.to], add_special_tokens=False).ids)
            assert sum(len(own.encode(t[x.p : x.to], add_special_tokens=False).ids) for x in rows) == len(own.encode(t, add_special_tokens=False).ids)


def batch(text, units):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(["k"]), pa.array([text]), pa.array(units, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))], names=["key", "text", "units"])


def chunk_batch(c):
    import pyarrow as pa

    names = ["key", "lo", "hi", "k", "at", "last", "part"]
    return pa.RecordBatch.from_arrays([pa.array([c[n]]) for n in names], names=names)


def test_extra_columns_empty_table_and_the_query(spark):
    df = spark.createDataFrame([(1, "a b", 5)], "`the.id` long, `a.text` string, n_tokens long")
    assert [tuple(r) for r in tokens.token_counts(df, "the.id", "a.text", PATH).collect()] == [(1, 3, 2, False)]
    assert tokens.token_counts(df.filter("n_tokens = 0"), "the.id", "a.text", PATH).collect() == []
    own, sf_dir = Tokenizer.from_file(PATH), "/root/testdata/sf0.001"
    want = {r.doc_id: len(own.encode(r.text or "", add_special_tokens=False).ids) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in tokens.op13_overlap_tokens(spark, sf_dir).collect()} == want
