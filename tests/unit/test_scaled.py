from pyspark.sql import functions as F

from veritab.functions import params, privacy, spans, text
from veritab.sources import grids


def test_values_are_not_dealt_by_key(spark):
    values = spark.createDataFrame([("A", "1,5"), ("B", "2"), (None, "3"), ("A", None)], "key string, value string")
    out = grids.scaled(values, spark.createDataFrame([("A", 100.0)], "key string, scale double"))
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, (r.number for r in out.collect()))) == ["150.0", "2.0", "3.0", "None"]


def test_found_compiles_no_pattern_for_a_row(spark):
    t = spark.createDataFrame([("a12b3",), ("x122",), ("😀7",), (None,), ("none",)], "t string")
    out = t.select("t", spans.found(F.col("t"), r"(?<!z)(\d)(\d)?", 2).alias("h"))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert ", -1" in plan and plan.count("regexp_replace") >= 1  # split at a mark; at the pattern only where a text holds one
    got = {r.t: [tuple(h) for h in r.h] for r in out.collect()}
    assert got == {"a12b3": [(1, 3, "2"), (4, 5, "")], "x122": [(2, 3, ""), (4, 6, "2")], "😀7": [(1, 2, "")], None: [], "none": []}


def test_gates_let_every_match_through(spark):
    said = ["10 kA", "6kW", "400 Wp", "90 lm", "3000 K", "230V", "alcance 8 m", "90 º", "eficiência 96,5 %", "b2CA", "Dca", "10 X 20 mm", "IP44", "u@x.pt", "999999990", "12345678 9 ZZ4", "CC: 123456", "+351 212 345 678", "4000–123", "OET n.º 123", "1.2.99", "maio 1999"]
    t = spark.createDataFrame([(x,) for x in said], "t string")
    for patterns, gates in (({k: v[2] for k, v in params.PARAMS.items()}, params.GATES), (privacy.PERSONAL, privacy.GATES)):
        for k, gate in gates.items():
            assert t.filter(F.col("t").rlike(patterns[k])).count() == t.filter(F.col("t").rlike(patterns[k]) & F.col("t").rlike(gate)).count() > 0, k


def test_core_folds_a_name_once(spark):
    name = F.concat(F.lit("Quadro Q.P. Á"), F.col("id"))
    out = spark.range(2).groupBy(text.core(name).alias("c")).count()
    assert out._jdf.queryExecution().analyzed().toString().count("Quadro Q.P.") <= 6  # thrice in each of the two lists
    assert sorted(r.c for r in out.collect()) == ["A0", "A1"]


def test_texts_without_rare_kinds_are_not_searched_for_them(spark):
    said = ["10.1.99", "MAIO|1999", "abril de 2001", "julho/2020", "março  1999", "12345678 9 ZZ4", "C.C. 123456", "912345678", "4000 - 100", "999999990", "u@x.pt OET 123", "Rua Nova e 1234", None]
    t = spark.createDataFrame([(x,) for x in said], "t string")
    both = t.select("t", privacy.masked(F.col("t")).alias("a"), privacy.masked(F.col("t"), dict(privacy.PERSONAL)).alias("b"))
    assert all(r.a == r.b for r in both.collect())
    assert both._jdf.queryExecution().analyzed().toString().count("CASE WHEN RLIKE(t") == 1
    for k, gate in privacy.RARE.items():
        assert t.filter(F.col("t").rlike(privacy.PERSONAL[k])).count() == t.filter(F.col("t").rlike(privacy.PERSONAL[k]) & F.col("t").rlike(gate)).count() > 0, k
