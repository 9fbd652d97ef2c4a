"""Boolean rules as nested tuples, turned into one Spark expression that Catalyst evaluates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritab.functions.numbers import rule_number
from veritab.functions.text import fold, folded_value

#: Texts of values that are there and say nothing.
EMPTY = ("", "[]", "{}")


def compared(field: Column, op: str, value) -> Column:
    """One comparison, two-valued: a missing or empty field is false, even for ``<>``.

    ``~`` is true if the folded text holds the folded value. Two numbers compare as numbers; texts are equal or not
    when folded (accents, case and blanks do not count), and have no order.
    """
    said = field.cast("string")
    if op == "in":
        return reduce(lambda a, b: a | b, [compared(field, "=", v) for v in value], F.lit(False))
    if op == "~":
        return F.coalesce(fold(said).contains(folded_value(str(value))), F.lit(False))
    left, right = rule_number(said), rule_number(F.lit(str(value)))
    numeric = {"=": left == right, "<>": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
    same = fold(said) == F.lit(folded_value(str(value)))
    textual = {"=": same, "<>": ~same}.get(op, F.lit(False))
    test = F.when(left.isNotNull() & right.isNotNull(), numeric).otherwise(textual)
    return F.coalesce(F.when(said != "", test), F.lit(False))


def condition(rule: tuple, linked: Column | None = None) -> Column:
    """("const", bool), ("all" | "any", rules...), ("not", rule), ("has", field), ("in", field, values), (op, field, value).

    Every node is true or false, so that ``not`` of a missing value is true. ``has`` is false for nulls, empty texts
    and empty collections, unless ``linked``, an array of keys that articles are linked to, holds the field.
    """
    op, *args = rule
    if op == "const":
        return F.lit(bool(args[0]))
    if op in ("all", "any"):
        return reduce(lambda a, b: a & b if op == "all" else a | b, [condition(r, linked) for r in args], F.lit(op == "all"))
    if op == "not":
        return ~condition(args[0], linked)
    field = F.col(args[0])
    if op == "has":
        there = F.coalesce(~field.cast("string").isin(*EMPTY), F.lit(False))
        return there if linked is None else there | F.coalesce(F.array_contains(linked, args[0]), F.lit(False))
    return compared(field, op, args[1])


def told(rule: tuple) -> str:
    """A rule as people read it."""
    op, *args = rule
    if op == "const":
        return str(bool(args[0])).lower()
    if op in ("all", "any"):
        return "(" + (" and " if op == "all" else " or ").join(map(told, args)) + ")"
    if op == "not":
        return f"not {told(args[0])}"
    if op == "has":
        return f"has {args[0]}"
    return f"{args[0]} {op} {', '.join(map(str, args[1])) if op == 'in' else args[1]}"


def explained(rule: tuple, linked: Column | None = None) -> Column:
    """Why a rule is false on a row: the clauses that make it so, as texts; empty where it is true.

    Of ``all`` the clauses that fail, of ``any`` every clause if none holds; a ``not`` is told whole.
    """
    op, *args = rule
    none, holds = F.array().cast("array<string>"), condition(rule, linked)
    if op == "all":
        return F.concat(none, *[explained(r, linked) for r in args])
    if op == "any":
        return F.when(holds, none).otherwise(F.concat(F.array(F.lit("none of")) if not args else none, *[explained(r, linked) for r in args]))
    return F.when(holds, none).otherwise(F.array(F.lit(told(rule))))
