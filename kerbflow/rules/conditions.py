"""Rule conditions as data, compiled to Spark columns.

A missing tag never makes a comparison unknown: ``==`` with a missing value is false, ``!=`` is true, and an
ordering test is false. Every compiled condition is therefore true or false, never NULL, and ``~`` simply
flips it.
"""

from __future__ import annotations

from collections.abc import Container, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = str | int | float


class Condition:
    def __and__(self, other: "Condition") -> "Condition":
        return All((self, other))

    def __or__(self, other: "Condition") -> "Condition":
        return Any((self, other))

    def __invert__(self) -> "Condition":
        return Not(self)


@dataclass(frozen=True)
class Test(Condition):
    column: str
    op: str
    values: tuple[Value, ...]


@dataclass(frozen=True)
class All(Condition):
    parts: tuple[Condition, ...]


@dataclass(frozen=True)
class Any(Condition):
    parts: tuple[Condition, ...]


@dataclass(frozen=True)
class Not(Condition):
    part: Condition


class Tag:
    """``tag("highway") == "primary"``, ``tag("bicycle").one_of(...)``, ``tag("lane_count") >= 3``."""

    def __init__(self, column: str):
        self.column = column

    def __eq__(self, value: Value) -> Condition:  # type: ignore[override]
        return Test(self.column, "in", (value,))

    def __ne__(self, value: Value) -> Condition:  # type: ignore[override]
        return Not(Test(self.column, "in", (value,)))

    def one_of(self, *values: Value) -> Condition:
        return Test(self.column, "in", values)

    def none_of(self, *values: Value) -> Condition:
        return Not(Test(self.column, "in", values))

    def __gt__(self, value: Value) -> Condition:
        return Test(self.column, ">", (value,))

    def __ge__(self, value: Value) -> Condition:
        return Test(self.column, ">=", (value,))

    __hash__ = None  # type: ignore[assignment]


def tag(column: str) -> Tag:
    return Tag(column)


def columns_of(condition: Condition) -> set[str]:
    if isinstance(condition, Test):
        return {condition.column}
    if isinstance(condition, Not):
        return columns_of(condition.part)
    return set().union(*(columns_of(p) for p in condition.parts))


def _literal(value: Value) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else str(value)


def condition_sql(condition: Condition, known: Container[str] | None = None) -> str:
    """Spark SQL text of a condition; a column not in ``known`` counts as missing everywhere.

    Text keeps a rule set of dozens of conditions cheap to build: one parsed expression instead of one
    driver call per operand.
    """
    if isinstance(condition, Not):
        return f"NOT ({condition_sql(condition.part, known)})"
    if isinstance(condition, (All, Any)):
        word = " AND " if isinstance(condition, All) else " OR "
        return "(" + word.join(condition_sql(p, known) for p in condition.parts) + ")"
    if known is not None and condition.column not in known:
        return "false"
    if condition.op == "in":
        test = f"`{condition.column}` IN ({', '.join(_literal(v) for v in condition.values)})"
    else:
        test = f"`{condition.column}` {condition.op} {_literal(condition.values[0])}"
    return f"coalesce({test}, false)"


def compile_condition(condition: Condition, known: Container[str] | None = None) -> Column:
    """Two-valued boolean column of a condition."""
    return F.expr(condition_sql(condition, known))


def describe(condition: Condition) -> str:
    """Readable text of a condition, stored as provenance next to the value it set."""
    if isinstance(condition, Not):
        return f"not ({describe(condition.part)})"
    if isinstance(condition, (All, Any)):
        return (" and " if isinstance(condition, All) else " or ").join(
            f"({describe(p)})" if isinstance(p, (All, Any)) else describe(p) for p in condition.parts)
    if condition.op == "in":
        return f"{condition.column} in {', '.join(str(v) for v in condition.values)}" if len(
            condition.values) > 1 else f"{condition.column} = {condition.values[0]}"
    return f"{condition.column} {condition.op} {condition.values[0]}"


def usable(conditions: Iterable[Condition], present: set[str] | None) -> list[bool]:
    """Whether each rule may run: with ``present`` given, a rule naming an absent column is skipped."""
    return [present is None or columns_of(c) <= present for c in conditions]
