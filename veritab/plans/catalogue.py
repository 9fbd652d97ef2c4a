"""All named queries with their SQL: importing the modules registers them."""

from veritab.plans import domain, findings, histories, queries, readings, texts  # noqa: F401
from veritab.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
