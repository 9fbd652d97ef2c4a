import random
import re


from veritab.functions import privacy
from veritab.operators import pseudonyms, sequences
from veritab.plans import texts


def test_decisions_see_what_the_former_left(spark):
    r = random.Random(2)
    names = {sequences.issue: ["ignore", "reopen", "fix", "?"], sequences.revision: ["read", "confirm", "resolve"], sequences.document: ["edit", "approve_section", "approve"], sequences.block: ["require", "review", "approved", "rejected"]}
    for machine, actions in names.items():
        rows = [(f"k{r.randrange(6)}", i, r.choice(actions), r.choice(["approved", "rejected"]) if machine is sequences.block else r.choice(["a", "b", "conflict", None]), r.randrange(sequences.SECTIONS)) for i in range(400)]
        want, state = [], {}
        for k, i, action, arg, section in rows:
            state[k], why, shown = machine(state.get(k), {"action": action, "arg": arg, "section": section})
            want.append((k, i, why, shown["status"], shown["detail"]))
        df = spark.createDataFrame([*rows, (None, 1, actions[0], "a", 0)], "key string, seq long, action string, arg string, section int").repartition(5)
        assert sorted(map(tuple, sequences.decided_in_order(df, machine).collect()), key=lambda x: x[1]) == want
        assert {w[2] for w in want} > {None} and sequences.decided_in_order(df.limit(0), machine).collect() == []


def steps(machine, *decisions):
    state, out = None, []
    for action, arg, section in decisions:
        state, why, shown = machine(state, {"action": action, "arg": arg, "section": section})
        out.append((why, shown["status"], shown["detail"]))
    return out


def test_a_confirmed_revision_supersedes_the_last():
    got = steps(sequences.revision, ("confirm", None, 0), ("read", None, 0), ("confirm", None, 0), ("read", "conflict", 0), ("confirm", None, 0), ("resolve", None, 0), ("confirm", None, 0))
    assert got == [("no draft", "none", "0/0/0/0"), (None, "draft", "1/0/0/0"), (None, "confirmed", "1/1/0/0"), (None, "draft", "2/1/0/1"), ("open conflicts", "draft", "2/1/0/1"), (None, "draft", "2/1/0/0"), (None, "confirmed", "2/2/1/0")]


def test_approval_and_the_next_revision():
    got = steps(sequences.document, ("edit", "a", 0), ("approve_section", "a", 0), ("approve_section", "b", 0), ("approve", "b", 0), ("approve_section", "b", 1), ("approve_section", "b", 2), ("approve", "b", 0), ("edit", "a", 1))
    assert got[1][0] == "own edit" and got[3][0] == "sections open" and got[6] == (None, "approved", "1/3") and got[7] == (None, "draft", "2/2")


def test_requirements_follow_their_block():
    got = steps(sequences.block, ("require", None, 0), ("require", None, 0), ("review", "rejected", 0), ("approved", None, 0), ("require", None, 0), ("approved", None, 0))
    assert got[3] == (None, "approved", "0/1/1") and got[4] == (None, "approved", "0/2/1") and got[5][0] == "approved"


def test_numbers_last_and_a_failed_check_leaves_the_old_map(spark, tmp_path):
    people = pseudonyms.PseudonymMap(spark, str(tmp_path / "map"))
    make = lambda rows: spark.createDataFrame(rows, "kind string, key string").repartition(3)
    shown = lambda df: sorted((r.kind, r.number, r.key, r.run) for r in df.collect())
    assert people.current().count() == 0
    name, _ = people.extended(make([("a", "y"), ("a", "x"), ("a", "x"), ("b", "x"), ("b", None), (None, "q")]))
    assert people.current().count() == 0 and people.swap(name, make([]).limit(0)) == 0
    first = [("a", 1, "x", 1), ("a", 2, "y", 1), ("b", 1, "x", 1)]
    assert shown(people.current()) == first
    name, more = people.extended(make([("a", "w"), ("a", "y"), ("c", "z")]))
    assert shown(more) == sorted([*first, ("a", 3, "w", 2), ("c", 1, "z", 2)])
    assert people.swap(name, make([("a", "left")])) == 1 and shown(people.current()) == first
    name, _ = people.extended(make([("a", f"n{i:03}") for i in range(200)] + [("a", "w")]))
    people.swap(name, make([]).limit(0))
    now = {(r.kind, r.key): (r.number, r.run) for r in pseudonyms.PseudonymMap(spark, str(tmp_path / "map")).current().collect()}
    assert now["a", "x"] == (1, 1) and now["a", "n000"] == (3, 2) and now["a", "w"] == (203, 2) and len({n for (k, _), (n, _) in now.items() if k == "a"}) == 203


def test_pseudonymised_documents(spark):
    sf = "/root/testdata/sf0.001"
    people, got, left = texts._two_runs(spark, sf)
    numbers = {(r.kind, r.key): r.number for r in people.current().collect()}
    assert left == 0 and people.run() == 2 and numbers
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    n = 0
    for r in got.collect():
        text, taken = rows[r.doc_id], []
        for k, p in privacy.PATTERNS.items():
            taken += [(*m.span(), k) for m in re.finditer(p, text or "") if all(m.end() <= a or m.start() >= b for a, b, _ in taken)]
        for a, b, k in sorted(taken, reverse=True):
            text, n = text[:a] + f"[{k} {numbers[k, text[a:b].lower()]}]" + text[b:], n + 1
        assert r.text == text
    assert n > 10
