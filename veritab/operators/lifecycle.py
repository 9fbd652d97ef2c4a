"""Findings: fingerprints, order, and what changes from one run to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.functions.text import fingerprint
from veritab.operators.windows import first_per

SEVERITIES = ("critical", "warning", "info")


def findings(df: DataFrame, rule: str, severity: str, key, message) -> DataFrame:
    """Rows of the common shape: rule_id, severity, key, fingerprint, message."""
    return df.select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), key.alias("key"), fingerprint(F.lit(rule), key).alias("fingerprint"), message.alias("message"))


def severity_rank(col: str = "severity"):
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col(col))


def merged(*parts: DataFrame) -> DataFrame:
    """All findings of several rules, one per fingerprint (the least message), by severity and rule."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return first_per(every, ["fingerprint"], F.col("message")).orderBy(severity_rank(), "rule_id", "fingerprint")


def persist(before: DataFrame, now: DataFrame) -> DataFrame:
    """(fingerprint, state): new, open, ignored or fixed.

    ``before`` (fingerprint, status) is the run that finished last; a finding that it ignored stays ignored, one
    that is missing now is fixed, and a finding that was missing in it starts anew.
    """
    b, n = before.select(F.col("fingerprint").alias("b"), "status"), now.select(F.col("fingerprint").alias("n")).distinct()
    j = b.join(n, F.col("b") == F.col("n"), "full_outer")
    state = F.when(F.col("n").isNull(), "fixed").when(F.col("b").isNull(), "new").when(F.col("status") == "ignored", "ignored").otherwise("open")
    return j.select(F.coalesce("n", "b").alias("fingerprint"), state.alias("state"))


def persist_runs(found: DataFrame) -> DataFrame:
    """(run, fingerprint, state) of every run but the first against the one before it, as :func:`persist` has it.

    ``found`` (run, fingerprint, status): one row for each finding of a run; runs are numbered without gaps.
    """
    ends = found.agg(F.min("run").alias("first"), F.max("run").alias("last"))  # one row
    all_ = found.join(F.broadcast(ends))
    b = all_.filter("run < last").select((F.col("run") + 1).alias("br"), F.col("fingerprint").alias("b"), "status")
    n = all_.filter("run > first").select(F.col("run").alias("nr"), F.col("fingerprint").alias("n"))
    j = b.join(n, (F.col("br") == F.col("nr")) & (F.col("b") == F.col("n")), "full_outer")
    state = F.when(F.col("n").isNull(), "fixed").when(F.col("b").isNull(), "new").when(F.col("status") == "ignored", "ignored").otherwise("open")
    return j.select(F.coalesce("nr", "br").alias("run"), F.coalesce("n", "b").alias("fingerprint"), state.alias("state"))
