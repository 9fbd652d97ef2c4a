import random


from veritab.operators import draft
from veritab.streaming import draft as stream
from veritab.streaming import seconds


def run(*events):
    now, out = None, []
    for kind, source, *values in events:
        now, action = draft.step(now, kind, source, [{"form": v, "value": v} for v in values])
        out.append((action, *draft.told("k", 0, now, action)[3:]))
    return out


def test_states_of_a_key():
    assert run(("read", "s", "1")) == [("new", "1", "pending", "s", None)]
    assert run(("read", "s", "1"), ("read", "s", "2"))[1] == ("replace", "2", "pending", "s", None)
    assert run(("read", "s", "1"), ("read", "t", "1"))[1] == ("agree", "1", "pending", "s", None)
    assert run(("read", "s", "1"), ("read", "t", "2"))[1] == ("conflict", None, "conflict", "s", "s=1 / t=2")
    assert run(("read", "s", "1"), ("read", "t", "2"), ("read", "t", "3"))[2] == ("joined", None, "conflict", "s", "s=1 / t=3")
    assert run(("read", "s", "1"), ("read", "t", "2"), ("read", "u", "1"))[2][4] == "s=1 / t=2 / u=1"
    assert run(("read", "s", "1", "2")) == [("conflict", None, "conflict", "s", "s=1 / s=2")]
    assert run(("read", "t", "9"), ("read", "s", "1", "2"))[1][4] == "t=9 / s=1 / s=2"
    assert run(("read", "s", "9"), ("read", "s", "1", "2"))[1][4] == "s=1 / s=2"
    both = (("read", "s", "1"), ("read", "t", "2"))
    assert run(*both, ("choose", "t"))[2] == ("closed", "2", "pending", "t", None)
    assert run(*both, ("choose", "x"))[2][0] == "refused" and run(("choose", None)) == [("refused", None, None, None, None)]
    assert run(*both, ("manual", None, "7"), ("read", "s", "7"), ("read", "t", "2"))[2:] == [("closed", "7", "pending", "manual", None), ("agree", "7", "pending", "manual", None), ("conflict", None, "conflict", "manual", "manual=7 / t=2")]
    assert run(("read", "s"), ("manual", None, "1"))[1][0] == "closed"


def rows(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        kind = r.choice(["read"] * 6 + ["choose", "manual"])
        values = [r.choice("123") for _ in range(1 if kind == "manual" else 0 if kind == "choose" else r.choice([1, 1, 1, 2]))]
        for v in values or [None]:
            out.append((f"k{r.randrange(9)}" if r.random() < 0.7 else "hot", i, kind, r.choice(["s", "t", "u", None]) if kind == "choose" else r.choice("stu"), v, v))
    return out


def test_batches_give_the_state_of_one_batch(spark, tmp_path):
    """Many small batches, in three runs of the stream with a restart between them."""
    data = rows(1, 300)
    make = lambda part: draft.readings(spark.createDataFrame(part, "key string, seq long, kind string, source string, form string, value string"))
    whole = sorted(map(tuple, draft.merged_in_order(make(data)).collect()), key=repr)
    assert len({r[2] for r in whole}) == 7
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for n, part in enumerate([data[:100], data[100:101], data[101:200], data[200:]]):
            make(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            if n != 1:
                stream.drain(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), 1)
        got = sorted(map(tuple, stream.steps_of(spark, str(tmp_path / "out")).collect()), key=repr)
        stream.drain(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))  # nothing new
        assert stream.steps_of(spark, str(tmp_path / "out")).count() == len(whole)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == whole


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, 1, "read", "s", "1", "1"), ("a", 1, "read", None, None, None), ("a", 2, "read", None, "x", None)], "key string, seq long, kind string, source string, form string, value string")
    assert sorted(map(tuple, draft.merged_in_order(draft.readings(df)).collect())) == [("a", 1, "agree", None, None, None, None), ("a", 2, "new", None, "pending", None, None)]
    assert draft.merged_in_order(draft.readings(df.limit(0))).collect() == []


def test_a_batch_counts_once(spark, tmp_path):
    sums = spark.createDataFrame([(1, "a", "d", 5, 1), (2, "a", "d", 7, 2)], "user_id int, step string, day string, seconds long, beats long")
    ledger = seconds.Ledger(spark, str(tmp_path / "t"))
    totals = lambda: sorted((r.user_id, r.seconds, r.beats) for r in ledger.totals(sums).collect())
    assert totals() == []
    ledger.fold()
    sums.limit(0).write.parquet(str(tmp_path / "t/batch-0"))  # a try that failed before its number was noted
    assert totals() == [] and ledger.add(sums, 0) and not ledger.add(sums, 0) and totals() == [(1, 5, 1), (2, 7, 2)]
    ledger.add(sums, 1)
    ledger._note("batch", 1, 1)  # noted twice
    assert totals() == [(1, 10, 2), (2, 14, 4)]
    ledger.fold()
    assert not ledger.add(sums, 1) and totals() == [(1, 10, 2), (2, 14, 4)]
    ledger.add(sums, 2)
    again = seconds.Ledger(spark, str(tmp_path / "t"))
    assert [e[0] for e in again.entries()] == ["batch", "folded"] and totals() == [(1, 15, 3), (2, 21, 6)]


def test_a_replayed_stream_adds_nothing(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = str(tmp_path / "in")
    events.repartition(3).write.parquet(src)
    ledger = seconds.run_once(spark, src, str(tmp_path / "out"), str(tmp_path / "ck"), 1)
    want = sorted(map(repr, seconds.step_seconds(events).select("user_id", "step", "day", "seconds", "beats").collect()))
    shown = lambda: sorted(map(repr, ledger.totals().select("user_id", "step", "day", "seconds", "beats").collect()))
    assert shown() == want and len(ledger.entries()) == 3
    assert not ledger.add(seconds.step_seconds(events), 1) and shown() == want  # the second batch once more
    events.limit(10).write.mode("append").parquet(src)
    seconds.run_once(spark, src, str(tmp_path / "out"), str(tmp_path / "ck"), 1)
    assert len(ledger.entries()) == 4 and shown() != want


def test_a_key_costs_two_calls_to_the_store_at_most():
    """Readings come as rows in any order; the draft is read once, and written once if it changed."""
    calls = []

    class Kept:
        value = None

        def exists(self):
            calls.append("exists")
            return self.value is not None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    p = stream.DraftProcessor()
    p.draft = Kept()
    row = lambda seq, kind, source, *read: {"seq": seq, "kind": kind, "source": source, "read": [{"form": x, "value": x} for x in read] or None}
    told = lambda *rows: [(r["key"], r["seq"], r["action"], r["value"]) for r in p.handleInputRows(("k",), iter(rows), None)]
    assert told(row(1, "choose", None)) == [("k", 1, "refused", None)] and calls == ["get"]
    assert told(row(3, "read", "t", "2"), row(2, "read", "s", "1"), row(3, "choose", None)) == [("k", 2, "new", "1"), ("k", 3, "refused", "1"), ("k", 3, "conflict", None)]
    assert calls == ["get", "get", "update"]
    assert told(row(4, "read", "u")) == [("k", 4, "agree", None)] and calls[3:] == ["get"]
