import re

from pyspark.sql import functions as F

from veritab.functions import text
from veritab.operators import extract, mining


def paragraphs(spark, *rows):
    return spark.createDataFrame([(1, "m", kind, section, i, t) for i, (kind, section, t) in enumerate(rows)], "project int, piece string, section_kind string, section string, idx int, text string")


def found(df):
    return sorted((r.key, r.value, r.idx) for r in df.collect())


def test_text_facts(spark):
    p = paragraphs(
        spark, ("block", "x", "Potência de 34,50 kVA; atualmente 10,35kVA."), ("block", "x", "UPS 10kVA e um gerador de 30 kVA"), ("cover", "x", "99 kVA"), ("block", "quadros", "São instalados 3 quadros elétricos: Q.P.ÁTRIO, (Q.E.G.) e Q.P.ÁTRIO."),
        ("block", "distribuicao", "mais 4 quadros elétricos"), ("block", "veiculos_eletricos", "dois pedestais com dois carregadores em cada"), ("block", "fotovoltaica", "22 módulos de 550 Wp, 12,1 kWp"), ("block", "iluminacao", "Tipo L10.2, l2 e SNC – embutida"), ("block", "iluminacao", "a L99 fica"),
        ("block", "iluminacao_comando", "L5 - comando"), ("block", "x", None),
    )
    assert found(extract.text_facts(p)) == sorted([
        ("ele.potencia_alimentar_kva", "34,5", 0), ("ele.potencia_existente_kva", "10,35", 0), ("ele.potencia_alimentar_kva", "30", 1), ("qty.quadros", "3", 3), ("names.quadros", "ATRIO, QEG", 3),
        ("qty.ve_carregadores", "4", 5), ("qty.fv_modulos", "22", 6), ("fv.potencia_kwp", "12,1", 6), ("types.luminarias", "L2, L10, SNC", 7),
    ])
    assert extract.text_facts(p.limit(0)).collect() == []


def test_identity_facts(spark):
    p = paragraphs(
        spark, ("cover", "", "REQUERENTE : Município  de X,"), ("cover", "", "localização: Rua Nova 5"), ("cover", "", "3000-123, Coimbra"), ("cover", "", "Obra Escola"), ("cover", "", "4000-100 Porto"), ("cover", "", "Obra: abc"),
        ("signature", "", "Coimbra, junho de 2026."), ("signature", "", "Ana Maria Silva, Engenheira eletrotécnica"), ("signature", "", "C.C. n.º: 1"), ("signature", "", "Membro OET: 12345"), ("signature", "", "Código de verificação: ab12"), ("signature", "", "Tel. 912 345 678"), ("signature", "", None),
    )
    assert found(extract.identity_facts(p)) == sorted([
        ("id.requerente.nome", "Município de X", 0), ("id.local.rua", "Rua Nova 5", 1), ("id.local.cp", "3000-123", 2), ("id.local.concelho", "Coimbra", 2), ("id.obra.designacao", "Escola", 3),
        ("doc.local", "Coimbra", 6), ("doc.data", "junho de 2026", 6), ("tec.nome", "Ana Maria Silva", 7), ("tec.titulo", "Engenheira eletrotécnica", 7), ("tec.cc", "1", 8), ("tec.oet", "12345", 9), ("tec.codigo_verificacao", "ab12", 10), ("tec.telefone", "912 345 678", 11),
    ])


def test_reference_lines(spark):
    from pyspark.sql import functions as F

    lines = {
        "Quadro JSL 317N, ou equivalente": ("JSL", "317N", None, True), "Tomada da marca EFAPEL, modelo Logus 90 com tampa": ("EFAPEL", "Logus 90", None, False), "Legrand série Mosaic, ref. 45011 S": ("Legrand", "Mosaic", "45011 S", False),
        "Projetor do tipo Philips Vaya": ("Philips", "Vaya", None, False), "Detetor ABB REF. KNX TXD505 ou equivalentes": ("ABB", None, "KNX TXD505", True), "Modelo 5 sem marca": None, "Hager composto por um recetor": None, None: None,
    }
    df = spark.createDataFrame([(t,) for t in lines], "t string")
    df = df.withColumn("low", text.fold(F.col("t")))
    got = {r.t: (tuple(r.f) if r.f is not None else None) for r in df.select("t", mining.reference_line(F.col("t"), F.col("low"), ["JSL", "EFAPEL", "Legrand", "Philips", "ABB", "Hager"]).alias("f")).collect()}
    assert got == lines


def test_associations(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (1, "b", "x"), (2, "a", "x"), (3, "a", "y"), (3, "b", "y"), (4, "b", "y"), (5, None, "y"), (6, "c", None)]
    df = spark.createDataFrame(rows, "doc int, term string, kind string")
    got = sorted((r.kind, r.term, r.n, r.of_term, r.of_kind, r.lift) for r in mining.associations(df.select("doc", "term"), df.select("doc", "kind").distinct(), 2).collect())
    assert got == [("x", "a", 2, 3, 2, 1666666), ("y", "b", 2, 3, 3, 1111111)]
    kinds = df.select("doc", "kind").distinct()
    assert [tuple(r) for r in mining.never_said(df.select("doc", "term"), kinds, 1).collect()] == []
    more = spark.createDataFrame([(9, "d", "x"), (10, "d", "x"), (11, "e", "y")], "doc int, term string, kind string").unionByName(df)
    assert sorted(tuple(r) for r in mining.never_said(more.select("doc", "term"), more.select("doc", "kind").distinct(), 2).collect()) == [("y", "d", 2)]


def test_paragraphs_are_read_twice(spark):
    p = paragraphs(spark, ("block", "quadros", "sai o Q.P.1 e o Q.P.2"))
    assert extract.text_facts(p)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 2


def test_terms_of_a_document_are_dealt_once(spark):
    from veritab.operators.mining import _told

    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "x")], "doc int, term string, kind string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = _told(df, df.select("doc", "kind").distinct())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"hashpartitioning\(doc#\d+, term", plan)  # dealt by document, not once more by document and term


def test_few_terms_need_no_runs(spark):
    from veritab.operators import checks

    p = spark.createDataFrame([(1, "a b b c"), (2, "ab"), (3, ""), (4, None)], "id int, w string")
    t = spark.createDataFrame([("b",), ("b c",), ("a b",), ("ab",), (None,)], "term string")
    few, many = (checks.terms_in(p, F.col("w"), t, few=n) for n in (64, 0))
    assert few.columns == many.columns and "explode" not in few._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == [("a b", 1, "a b b c"), ("ab", 2, "ab"), ("b", 1, "a b b c"), ("b c", 1, "a b b c")]
