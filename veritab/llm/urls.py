"""URL filters: host-suffix and path-prefix expressions, joined to rules on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm.common import small, table

#: The rules of the query: verdict, host, path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(urls: DataFrame, url_col: str, rules: DataFrame, default: str = "allow", prefix: int = 8) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``urls``; other columns stay.

    ``rules`` has verdict, host and path. Each distinct (host, path) expands into its host suffixes, cut at
    dots, times those path prefixes whose length some rule has; the expressions meet the rules on the first
    ``prefix`` hex digits of their SHA-256, the whole digest confirms, and the longest rule wins (host and path
    together; then the longer host; at equal rules ``block`` wins). Rows without a rule get ``default``.

    Nulls: a null url, or one without ``://``, has an empty host and path, which no rule fits. Repeated rows are
    all kept. Columns of ``urls`` with the names of the results are replaced.
    """
    spark = urls.sparkSession
    rows = urls.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    r = rules.select("verdict", F.concat("host", "path").alias("expr"), F.length("host").alias("h"), F.length("path").alias("p"))
    r = r.groupBy("expr", "h", "p").agg(F.max("verdict").alias("rule_verdict"))
    r = r.withColumns({"digest": F.sha2("expr", 256)}).withColumn("short", F.substring("digest", 1, prefix))
    lengths = [x[0] for x in r.select("p").distinct().collect()]  # as many as there are lengths of rule paths
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = F.filter(F.array([F.lit(x).cast("int") for x in lengths]), lambda x: x <= F.length("path"))
    exprs = F.flatten(F.transform(suffixes, lambda s: F.transform(cuts, lambda c: F.concat(s, F.col("path").substr(F.lit(1), c)))))
    keys = rows.select("host", "path").filter(F.col("host") != "").distinct()
    wide = keys.select("host", "path", F.explode(exprs).alias("x")).withColumn("full", F.sha2("x", 256)).withColumn("short", F.substring("full", 1, prefix))
    hit = wide.join(small(r, r.count(), 10_000), "short").filter(F.col("full") == F.col("digest"))
    best = hit.groupBy("host", "path").agg(F.max(F.struct((F.col("h") + F.col("p")).alias("n"), "h", "expr", "rule_verdict")).alias("b"))
    best = best.select("host", "path", F.col("b.expr").alias("rule"), F.col("b.rule_verdict").alias("verdict"))
    return rows.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "verdict string, host string, path string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), "url", rules).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, strpos(url, '://') AS pos, substr(url, strpos(url, '://') + 3) AS rest FROM pages),
q AS (
  SELECT page_id, CASE WHEN pos > 0 THEN regexp_extract(rest, '^[^/?#]*') ELSE '' END AS h0, rest, pos FROM p),
u AS (
  SELECT page_id, translate(coalesce(h0, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN pos > 0 THEN regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*') ELSE '' END AS path FROM q),
r(verdict, rh, rp) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
b AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT u.page_id, host, path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM u LEFT JOIN b USING (page_id)
"""
