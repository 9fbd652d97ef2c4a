"""Queries against their SQL where keys are larger than those of the given tables."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from veritab.plans import catalogue

GIVEN = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["cover_facts", "shorter_forms"])
def test_keys_of_five_digits_that_meet(spark, tmp_path, name):
    line, part = (spark.read.parquet(f"{GIVEN}/{t}.parquet") for t in ("lineitem", "part"))
    line.withColumns({"l_suppkey": F.col("l_partkey") + 10_000, "l_partkey": F.col("l_partkey") + 10_000}).write.parquet(f"{tmp_path}/lineitem.parquet")
    part.withColumn("p_partkey", F.col("p_partkey") + 10_000).write.parquet(f"{tmp_path}/part.parquet")
    db = duckdb.connect()
    for t in ("lineitem", "part"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = catalogue.QUERIES[name](spark, str(tmp_path))
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({catalogue.SQL[name]})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want) and want
