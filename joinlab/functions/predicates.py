"""A small predicate language over columns: ten comparisons, AND, OR and NOT, rendered as Spark columns.

``two_valued_not``: NOT of an unknown comparison is true (NULL rows stay). ``strict_like``: ``%`` and
``_`` do not match a line feed, and a backslash in a pattern is an ordinary character. ``strict_types``: a comparison
of a column with a value of another type is false, where Spark would cast one of them or raise.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operator names and their signs.
SIGNS = {"eq": "=", "neq": "!=", "lt": "<", "gt": ">", "leq": "<=", "geq": ">=", "like": "LIKE", "not_like": "NOT LIKE", "is_null": "IS NULL", "is_not_null": "IS NOT NULL"}


@dataclass(frozen=True)
class Options:
    two_valued_not: bool = False
    strict_like: bool = False
    strict_types: bool = False


#: Spark's type names that a value of each Python type compares with under ``strict_types``.
KINDS = {bool: ("boolean",), int: ("tinyint", "smallint", "int", "bigint"), float: ("float", "double"), str: ("string",)}


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return And((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Or((self, other))

    def __invert__(self) -> Predicate:
        return Not(self)


def like_regex(pattern: str) -> str:
    """The whole-value regular expression of a LIKE pattern; only a line feed escapes its wildcards."""
    parts = {"%": ".*", "_": "."}
    return r"(?d)\A" + "".join(parts.get(c) or re.escape(c) for c in pattern) + r"\z"


def _like(col: Column, pattern: str, options: Options) -> Column:
    if options.strict_like:
        return col.rlike(like_regex(pattern))
    if "\\" in pattern:
        escape = next(c for c in map(chr, range(33, 0x10FFFF)) if c not in "%_\\" and c not in pattern)
        return F.like(col, F.lit(pattern), F.lit(escape))
    return col.like(pattern)


@dataclass(frozen=True)
class Comparison(Predicate):
    column: str
    op: str
    value: object = None

    def __post_init__(self):
        if self.op not in SIGNS:
            raise ValueError(f"unknown comparison {self.op}")

    def to_column(self, resolve=F.col, options: Options = Options()) -> Column:
        c, v = resolve(self.column), self.value
        if self.op == "is_null":
            return c.isNull()
        if self.op == "is_not_null":
            return c.isNotNull()
        if self.op in ("like", "not_like"):
            hit = _like(c, v, options)
            hit = hit if self.op == "like" else ~hit
        else:
            hit = {"eq": c == v, "neq": c != v, "lt": c < v, "gt": c > v, "leq": c <= v, "geq": c >= v}[self.op]
        if options.strict_types and type(v) in KINDS:
            return F.when(F.typeof(c).isin(*KINDS[type(v)]), hit).otherwise(F.lit(False))
        return hit

    def pretty(self) -> str:
        if self.op.startswith("is_"):
            return f"{self.column} {SIGNS[self.op]}"
        value = "'" + self.value.replace("'", "''") + "'" if isinstance(self.value, str) else str(self.value)
        return f"{self.column} {SIGNS[self.op]} {value}"


@dataclass(frozen=True)
class _Many(Predicate):
    parts: tuple

    def to_column(self, resolve=F.col, options: Options = Options()) -> Column:
        out = self.parts[0].to_column(resolve, options)
        for p in self.parts[1:]:
            nxt = p.to_column(resolve, options)
            out = out & nxt if isinstance(self, And) else out | nxt
        return out

    def pretty(self) -> str:
        return "(" + (" AND " if isinstance(self, And) else " OR ").join(p.pretty() for p in self.parts) + ")"


class And(_Many):
    pass


class Or(_Many):
    pass


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate

    def to_column(self, resolve=F.col, options: Options = Options()) -> Column:
        inner = self.part.to_column(resolve, options)
        return ~F.coalesce(inner, F.lit(False)) if options.two_valued_not else ~inner

    def pretty(self) -> str:
        return f"NOT {self.part.pretty()}"


def between(column: str, low, high) -> Predicate:
    return Comparison(column, "geq", low) & Comparison(column, "leq", high)


class OneOf(Or):
    """An OR of equalities on one column, rendered as IN, which has no depth and is pushed down as one filter."""

    def to_column(self, resolve=F.col, options: Options = Options()) -> Column:
        if options.strict_types:
            by_type = {type(p.value): [q.value for q in self.parts if type(q.value) is type(p.value)] for p in self.parts}
            c = resolve(self.parts[0].column)
            hits = [F.when(F.typeof(c).isin(*KINDS[k]), c.isin(*v)).otherwise(F.lit(False)) for k, v in by_type.items()]
            out = hits[0]
            for h in hits[1:]:
                out = out | h
            return out
        return resolve(self.parts[0].column).isin(*(p.value for p in self.parts))


def one_of(column: str, *values) -> Predicate:
    return OneOf(tuple(Comparison(column, "eq", v) for v in values)) if len(values) > 1 else Comparison(column, "eq", values[0])
