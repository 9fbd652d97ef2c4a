import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from veritab.functions import dates, numbers, params, privacy, text, words
from veritab.operators import checks, decisions, lifecycle, merge, sinks, summaries, windows
from veritab.plans.logic import condition
from veritab.sources import documents, grids, workbook
from veritab.streaming import seconds


def _one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_number_grammars_differ(spark):
    t = F.lit
    assert _one(spark, numbers.ingest_number(t("1.234")), numbers.checked_number(t("1.234")), numbers.ingest_number(t("1.234.567")), numbers.checked_number(t("1.234.567"))) == (1.234, 1234.0, None, 1234567.0)
    assert _one(spark, numbers.ingest_number(t("1.234,5")), numbers.checked_number(t("1 234,5")), numbers.rule_number(t("1.234,5")), numbers.rule_number(t("-2,5"))) == (1234.5, 1234.5, None, -2.5)
    assert _one(spark, numbers.number_text(F.lit(3.0)), numbers.number_text(F.lit(2.50)), numbers.number_text(F.lit(0.12345))) == ("3", "2,5", "0,1235")


def test_readings_and_checks(spark):
    s = lambda a, b: numbers.same_reading(F.lit(a), F.lit(b))
    assert _one(spark, s("503.4", "503"), s("503.45", "503.5"), s("504", "503.4"), s("1.005", "1.01"), s("x", "1")) == (True, True, False, True, None)
    v = numbers.three_valued
    assert _one(spark, v(F.lit(1), F.lit(2), F.lit(2)), v(F.lit(3), F.lit(2), F.lit(9)), v(F.lit(1), F.lit(None), F.lit(0))) == ("ok", "fail", "na")
    assert _one(spark, numbers.tax_number_ok(F.lit("501964843")), numbers.tax_number_ok(F.lit("501964844")), numbers.tax_number_ok(F.lit("12"))) == (True, False, False)


def test_text_and_dates(spark):
    assert _one(spark, text.fold(F.lit("  ÁrvoreS\n2.º ß² ")), text.slug(F.lit("Quadro Geral — 1")), text.slug(F.lit("--")), text.folded_text(F.lit("- Fim. "))) == ("arvores 2.o ss2", "quadro_geral_1", "sem_titulo", "fim")
    assert [_one(spark, text.letters(F.lit(n)))[0] for n in (0, 25, 26, 701, 702, 728)] == ["A", "Z", "AA", "ZZ", "AAA", "ABA"]
    m = dates.month_year
    assert _one(spark, m(F.lit("Março de 2024")), m(F.lit("3/24")), m(F.lit("13/2024")), m(F.lit("x"))) == ("2024-03", "2024-03", None, None)
    assert _one(spark, dates.shown_date(F.lit("2026-05-30")), dates.shown_date(F.lit("2026-05")), F.lit("2026-06") > F.lit("2026-05-30"), F.lit("2026-06") > F.lit("2026-06-10")) == ("30/05/2026", "maio de 2026", True, False)
    day = lambda y, mth, d: F.lit(dt.date(y, mth, d))
    assert _one(spark, dates.is_old(day(2020, 2, 29), 1, day(2021, 2, 28)), dates.is_old(day(2020, 2, 29), 1, day(2021, 3, 1)), dates.is_old(F.lit(None).cast("date"), 1, day(2021, 3, 1))) == (False, True, False)


def test_requirements(spark):
    s = lambda op, r, o: params.satisfies(F.lit(op), F.lit(r), F.lit(o))
    assert _one(spark, s(">=class", "IP55", "IP65"), s(">=class", "IP55", "IP44"), s(">=class", "IP54", "IPX4"), s(">=class", "Cca", "B2ca"), s(">=class", "Cca", "Eca"), s(">=class", "IK08", "IK10"), s(">=", "10", "n/a"), s("=", "1", "1.0")) == (True, False, None, True, False, True, None, True)


def test_personal_data(spark):
    t = "mail a.b@x.example.com from 10.0.0.1, call (212) 555-1234, card 4111111111111111"
    kinds = F.transform(privacy.personal(F.lit(t), privacy.PATTERNS), lambda h: h["kind"])
    assert _one(spark, kinds)[0] == ["email", "ip", "phone", "card"]
    assert _one(spark, privacy.masked(F.lit(t), privacy.PATTERNS), privacy.masked(F.lit(None).cast("string")), F.size(privacy.personal(F.lit("none")))) == ("mail ••• from •••, call •••, card •••", None, 0)


def test_nobody_wins_a_conflict(spark):
    rows = [("k", "a", 1, "5"), ("k", "a", 2, "5 "), ("k", "b", 3, "5"), ("m", "a", 4, "1"), ("m", "b", 5, "2"), ("n", "a", 6, "7"), ("o", "a", 7, "1"), ("o", "a", 8, "2")]
    df = spark.createDataFrame(rows, "key string, source string, ord int, v string")
    got = {r["key"]: (r["value"], r["status"], r["n_sources"], r["candidates"]) for r in merge.consolidate(df, ["key"], "source", "ord", F.trim("v"), F.col("v")).collect()}
    assert got == {"k": ("5 ", "agreed", 2, "5 "), "m": (None, "conflict", 2, "1 / 2"), "n": ("7", "pending", 1, "7"), "o": (None, "conflict", 1, "1 / 2")}


def test_windows(spark):
    df = spark.createDataFrame([(1, 1, "A", True), (1, 2, None, False), (1, 3, None, True), (1, 4, None, False)], "k int, o int, v string, p boolean")
    fill = windows.fill_forward(F.col("v"), F.col("p"), ["k"], F.col("o"))
    assert [r[0] for r in df.select(fill, "o").orderBy("o").collect()] == ["A", "A", None, None]
    rows = [(k, x) for k in (1, 2) for x in (0.0, 3.0, 3.5, 4.0, 7.4, 9.0, 9.0, None)]
    got = windows.anchored_groups(spark.createDataFrame(rows, "k long, x double"), "k", "x", 3.5).collect()
    assert sorted(map(tuple, got)) == sorted((k, *g) for k in (1, 2) for g in [(0.0, 3), (4.0, 2), (9.0, 2)])
    left = spark.createDataFrame([("a", 5, "x"), ("a", 0, "y"), ("b", 5, "z")], "k string, at int, n string")
    right = spark.createDataFrame([("a", 1, 10), ("a", 5, 50), ("a", 9, 90)], "k string, t int, v int")
    assert {(r["n"], r["v"]) for r in windows.as_of(left, right, "k", "at", "t", ["v"]).collect()} == {("x", 50), ("y", None), ("z", None)}
    assert _one(spark, summaries.compressed(F.array(*[F.lit(x) for x in (3, 1, 2, 7, 9, 8, 5)]))) == ("1-3, 5, 7-9",)


def test_lifecycle_and_rules(spark):
    before = spark.createDataFrame([("a", "ignored"), ("b", "open"), ("c", "open")], "fingerprint string, status string")
    now = spark.createDataFrame([("a",), ("b",), ("d",)], "fingerprint string")
    assert {(r["fingerprint"], r["state"]) for r in lifecycle.persist(before, now).collect()} == {("a", "ignored"), ("b", "open"), ("c", "fixed"), ("d", "new")}
    df = spark.createDataFrame([("1,5", None), (None, "x")], "n string, s string")
    rule = ("any", (">", "n", 1), ("all", ("has", "s"), ("not", ("has", "n"))))
    assert [r[0] for r in df.select(condition(rule), condition(("=", "s", "x")).alias("e")).collect()] == [True, True]
    assert df.filter(condition(("all",))).count() == 2 and df.filter(condition(("any",))).count() == 0


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>FE_v1 x</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="R45" t="s"><v>0</v></c><c r="B2"><v>4.5</v></c></row></sheetData></worksheet>')
    (tmp_path / "a.xlsx").write_bytes(data.getvalue())
    (tmp_path / "b.xlsx").write_bytes(b"not a workbook")
    cells = workbook.read_cells(spark, str(tmp_path))
    assert sorted((r["ref"] or "", r["value"] or "", r["note"] or "") for r in cells.collect()) == [("", "", "unreadable: BadZipFile"), ("B2", "4.5", ""), ("R45", "FE_v1 x", "")]
    maps = spark.createDataFrame([("FE_v1", "R45", "B2", "power"), ("FE_v1", "R45", "C3", "voltage"), ("FE_v2", "R45", "B9", "power")], "version string, version_ref string, ref string, key string")
    assert {(r["key"], r["value"]) for r in workbook.form_values(cells, maps).collect()} == {("power", "4.5"), ("voltage", None)}


def test_stream_gives_the_batch_result(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1 + i % 3, i % 24), i % 5, ["view", "click"][i % 2], float(i)) for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    src = str(tmp_path / "in")
    events.repartition(4).write.parquet(src)
    totals = seconds.run_once(spark, src, str(tmp_path / "out"), str(tmp_path / "ck")).totals()
    got = {tuple(r) for r in totals.select("user_id", "step", "day", "seconds", "beats").collect()}
    assert got == {tuple(r) for r in seconds.step_seconds(events).collect()}
    assert sum(r["n"] for r in seconds.late_counts(events).collect()) == 200


def test_words_and_names(spark):
    n = lambda s: _one(spark, words.words_to_int(F.lit(s)))[0]
    assert [n(x) for x in ("seis", "dezasseis", "vinte e dois", "cento e vinte", "42", "muitos")] == [6, 16, 22, 120, 42, None]
    q = lambda s: _one(spark, words.quantity_of(F.lit(s), "carregador(?:es)?", "pedesta(?:l|is)"))[0]
    assert q("sao instalados 3 pedestais com dois carregadores em cada") == 6
    assert (q("existem 5 carregadores, dos quais 2 carregadores sao rapidos"), q("dos quais 2 carregadores"), q("nada")) == (5, None, None)
    s = words.sheet_name(F.lit("QP1-2-QE 3.xls"))
    assert tuple(_one(spark, s)[0]) == ("QP1-2", "QE 3")
    assert _one(spark, words.cable_section(F.lit("H1XV-R 5G10")), words.cable_section(F.lit("4x1x185")), words.cable_section(F.lit("35 mm2")), words.cable_section(F.lit("x"))) == (10.0, 185.0, 35.0, None)
    df = spark.createDataFrame([(1, "Ana Maria Reis"), (2, "Ana Reis"), (3, "Rui Sol")], "id int, name string").select("id", F.explode(words.name_variants(F.col("name"))).alias("v"))
    assert {r["v"] for r in checks.unique_owner(df, "v", "id").collect()} == {"Ana Maria Reis", "Rui Sol", "R. Sol"}


def test_likely_reading_and_copies(spark):
    obs = [(1, "a", "x", "2024-01"), (1, "b", "x", "2024-01"), (1, "c", "y", "2024-02"), (2, "a", "x", "2024-03"), (2, "b", "x", "2024-03"), (2, "c", "y", "2024-01"), (3, "a", "x", "1"), (3, "b", "y", "1")]
    got = {r["k"]: (r["reading"], r["piece"]) for r in checks.likely_reading(spark.createDataFrame(obs, "k int, p string, v string, d string"), ["k"], "p", "v", "d").collect()}
    assert got == {1: ("others_outdated", "c"), 2: ("piece_wrong", "c"), 3: ("several", None)}
    a, b = checks.remapped(spark.createDataFrame([("p",)], "id string"), spark.createDataFrame([("c", "p")], "id string, parent string"), "id", "parent", "copy")
    assert a.join(b, a["id"] == b["parent"]).count() == 1


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_by_key(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), path, ["k"])
    sinks.replace_by_key(spark.createDataFrame([("b", 3)], "k string, v int"), path, ["k"])
    assert {(r["k"], r["v"]) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}
    m = sinks.manifest(spark.createDataFrame([("f", "abc")], "n string, c string"), "n", "c").first()[0]
    assert m == '{"name":"f","bytes":3,"sha256":"ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"}'


def test_decisions_are_guarded(spark):
    state = spark.createDataFrame([(1, "open"), (2, "done"), (3, "open")], "id int, status string")
    asked = spark.createDataFrame([(1, 1, "no"), (1, 2, "a long reason"), (2, 1, "a long reason"), (3, 1, "short"), (9, 1, "a long reason")], "id int, ord int, note string")
    guards = [("not open", F.col("status") == "open"), ("note too short", F.length("d_note") >= 10)]
    new, log = decisions.decide(state, asked, "id", "ord", guards, {"status": F.lit("ignored")})
    assert {tuple(r) for r in new.collect()} == {(1, "ignored"), (2, "done"), (3, "open")}
    assert {tuple(r) for r in log.collect()} == {(1, None), (2, "not open"), (3, "note too short"), (9, "unknown")}


def test_paragraphs_and_unique_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = f"<w:tbl><w:tr><w:tc>{p('a')}{p('b')}</w:tc><w:tc>{p('a b')}</w:tc><w:tc>{p('c')}</w:tc></w:tr></w:tbl>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('first')}{p(' ')}{table}{p('last')}</w:body></w:document>")
    for name in ("a.docx", "b.docx"):
        (tmp_path / name).write_bytes(data.getvalue())
    (tmp_path / "c.docx").write_bytes(b"no archive")
    got = documents.read_paragraphs(spark, str(tmp_path / "[ac].docx")).collect()
    assert [(r["kind"], r["text"], r["note"]) for r in sorted(got, key=lambda r: (r["path"], r["ord"]))] == [
        ("paragraph", "first", None), ("row", "a b | c", None), ("paragraph", "last", None), (None, None, "unreadable: BadZipFile")]
    assert sorted(r["path"][-6:] for r in grids.unique_files(spark, str(tmp_path)).collect()) == ["a.docx", "c.docx"]


def test_audit_log_and_staging(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, what string")
    log = sinks.AuditLog(str(tmp_path / "log"))
    log.append(df)
    log.append(df)
    assert log.rows(df).count() == 4
    for refuse in (log.update, log.delete, log.truncate):
        with pytest.raises(PermissionError):
            refuse(df)
    bad = lambda t: t.filter("what = 'b'")
    now = sinks.Versions(spark, str(tmp_path / "v"), df.schema)
    assert sinks.staged(df, str(tmp_path / "v"), bad) == 1 and now.current().count() == 0
    assert sinks.staged(df.filter("id = 1"), str(tmp_path / "v"), bad) == 0 and now.current().count() == 1
    assert sinks.staged(df, str(tmp_path / "v"), bad) == 1 and now.current().count() == 1 and now.run() == 1


def test_rules_are_two_valued(spark):
    df = spark.createDataFrame([(None, "[]", ["k"]), ("Évora", "x", None)], "t string, k string, links array<string>")
    rows = df.select(condition(("<>", "t", "a")).alias("a"), condition(("not", ("<>", "t", "a"))).alias("b"), condition(("has", "k"), F.col("links")).alias("c"), condition(("has", "k")).alias("d"), condition(("<", "t", "z")).alias("e"), condition(("in", "t", ["évora", "x"])).alias("f"))
    assert [tuple(r) for r in rows.collect()] == [(False, True, True, False, False, False), (True, False, True, True, False, True)]


def test_folds_equal_their_definition(spark):
    import random

    from veritab.functions import text

    r = random.Random(5)
    pool = [chr(c) for c in [*range(9, 14), *range(32, 127), *range(0xA0, 0x250), 0x1C, 0x300, 0x301, 0x2013, 0x2026, 0x20AC, 0xFB01, 0x1E9E, 0x4E2D, 0x1F600, 0x3000, 0x130, 0x212B]]
    rows = ["".join(r.choice(pool) for _ in range(r.randrange(12))) for _ in range(3_000)] + pool + ["São  João ", "ﬁm", None]
    got = spark.createDataFrame([(x,) for x in rows], "x string").select("x", text.fold(F.col("x")).alias("y")).collect()
    assert all(g.y == (None if g.x is None else " ".join(text._bare(g.x).split())) for g in got)


def test_accented_boards(spark):
    from veritab.functions.text import core

    names = {"Q.P.ÁTRIO": "ATRIO", "Q.P.ATRIO": "ATRIO", "átrio": "ATRIO", "Pavilhão": "PAVILHAO", "Quadro Q.E.G.": "QEG", "Armário": "PORTINHOLA", "Q.P.": "P", "QP1": "1", "Q": "Q", "": ""}
    got = {r.n: r.c for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", core(F.col("n")).alias("c")).collect()}
    assert got == names


def _grid(spark, *sheets):
    rows = [(p, n, r, c, v) for p, n, lines in sheets for r, line in enumerate(lines, 1) for c, v in enumerate(line, 1) if v is not None]
    return spark.createDataFrame(rows, "path string, sheet_no int, row int, col int, value string")


def test_calculation_table(spark):
    head = ["Destino", "Origem", "TIPO C", None, "Tipo\nF D", "Iz (A)", "1,45 x Iz", "Observações", "Fases", "Condutor", "N.º de polos", "Montagem", "Designação do cabo", "Iz (A)"]
    sub = [None, None, "Norma [kVA]", "Total instalado", "Disjuntor"]
    one = [["Tabela"], head, sub, [None, None, "EDIFÍCIO"], ["Q.P.1", "QEG", "3", "34,5", "Fusível", "1.200,5", "x", "nota", "Trifásico", "Alumínio", "tetrapolar", "Enterrado", "XZ1 4x1x185mm²", "9"], [], ["C1", None, None, None, "?", "", None, None, "2", "Zn", "?", "ar livre"]]
    two = [["Origem", "Destino"], ["a", "5"], ["PISO 1"], [None, "c"], ["d"], ["5"]]
    cells = _grid(spark, ("x", 1, [["Origem dos dados"], ["7"]]), ("x", 2, one), ("x", 3, one), ("y", 2, two), ("z", 1, [["nada", "Destino"]]))
    got = {(r.path, r.row): r.asDict() for r in grids.calc_rows(cells).collect()}
    assert [(k, got[k]["section"]) for k in sorted(got)] == [(("x", 5), "EDIFÍCIO"), (("x", 7), "EDIFÍCIO"), (("y", 2), None), (("y", 4), "PISO 1"), (("y", 6), "d")]
    a = got["x", 5]
    assert (a["sheet_no"], a["section"], a["origin"], a["destination"], a["kva"], a["protection_type"], a["iz_a"], a["iz145_a"]) == (2, "EDIFÍCIO", "QEG", "Q.P.1", 34.5, "F", 1200.5, None)
    assert (a["phases"], a["conductor"], a["pole_type"], a["installation"], a["section_mm2"]) == (3, "Al", "MUL", "ENT", 185.0)
    b = got["x", 7]
    assert (b["section"], b["origin"], b["protection_type"], b["phases"], b["conductor"], b["pole_type"], b["installation"]) == ("EDIFÍCIO", None, None, None, None, None, "AR")
    assert sorted(r.warning for r in grids.calc_warnings(cells).filter("path = 'x'").collect()) == ["Coluna não reconhecida: «Iz (A)».", "Coluna não reconhecida: «Observações»."]
    values = {r.key: r.value for r in grids.calc_values(grids.calc_rows(cells)).filter("path = 'x'").collect()}
    assert values == {"ele.potencia_alimentar_kva": "34.5", "ele.entrada": "Trif", "ele.quadros": "Q.P.1", "ele.cabos": "XZ1 4x1x185mm²"}


def test_places_of_many_hits_take_linear_time(spark):
    import time

    from veritab.functions import privacy, spans

    line = "mail a.b@c.pt, 912345678 and {{v:x}}; "
    for n in (0, 1, 255, 256, 257, 700):
        df = spark.createDataFrame([(line * n,)], "t string")
        hits = df.select(spans.found(F.col("t"), r"[a-z.]+@[a-z.]+").alias("h")).first()["h"]
        assert [(h.start, h.stop) for h in hits] == [(5 + i * len(line), 13 + i * len(line)) for i in range(n)]
        assert df.select(spans.blanked(F.col("t"), r"\{\{[a-z:]+\}\}").alias("b")).first()["b"] == line.replace("{{v:x}}", " " * 7) * n
        assert df.select(privacy.masked(F.col("t")).alias("m")).first()["m"] == line.replace("a.b@c.pt", privacy.MARK).replace("912345678", privacy.MARK) * n
    big = spark.createDataFrame([("x",)], "t string").withColumn("t", F.repeat(F.lit(line), 50_000))
    began = time.time()
    assert big.select(F.size(spans.found(F.col("t"), r"[a-z.]+@[a-z.]+")).alias("n"), F.length(privacy.masked(F.col("t"))).alias("m"), F.length(spans.blanked(F.col("t"), r"\{\{[a-z:]+\}\}")).alias("b")).first()["n"] == 50_000
    assert time.time() - began < 20
