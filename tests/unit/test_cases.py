import pytest
from pyspark.sql import functions as F

from tests.unit.cases import CASES


@pytest.mark.parametrize("name", sorted(CASES))
def test_cases(spark, name):
    inputs, outputs, cases, before = CASES[name]
    fields = [f.split()[0] for f in inputs.split(",")] if "array" not in inputs else [f.split()[0] for f in inputs.split(", ")]
    given = spark.createDataFrame([(i, *a) for i, (a, _) in enumerate(cases)], f"_c int, {inputs}")
    for k, f in before.items():
        given = given.withColumn(k, f(*[F.col(c) for c in fields]))
    out = given.select("_c", *[f(*[F.col(c) for c in fields]).alias(k) for k, f in outputs.items()])
    assert {r["_c"]: tuple(r)[1:] for r in out.collect()} == {i: want for i, (_, want) in enumerate(cases)}
