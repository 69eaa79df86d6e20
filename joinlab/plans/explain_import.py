"""Imports hash-join trees from EXPLAIN-style JSON, with filters and join conditions from the query's text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinlab.functions.predicates import Options
from joinlab.plans.sql_subset import Query

SCANS, PASSED = ("Seq Scan", "Index Only Scan"), ("Aggregate", "Gather")


class PlanError(ValueError):
    pass


def import_plan(tree: dict, query: Query, tables: dict[str, DataFrame], honour_build_side: bool = False, options: Options = Options()) -> DataFrame:
    """The tree's join order and build sides, every condition of the query, its filters at the scans."""

    def walk(node: dict) -> tuple[DataFrame, set[str]]:
        kind, below = node.get("Node Type"), node.get("Plans", [])
        if kind in PASSED or kind == "Hash":
            if len(below) != 1:
                raise PlanError(f"{kind} needs one child")
            return walk(below[0])
        if kind in SCANS:
            alias = node.get("Alias") or node.get("Relation Name")
            if alias not in query.aliases:
                raise PlanError(f"unknown alias {alias}")
            df = tables[query.aliases[alias]]
            for predicate in query.filters.get(alias, []):
                df = df.where(predicate.to_column(lambda c: F.col(c.split(".")[-1]), options))
            for x, y in query.graph.within(alias):
                df = df.where(F.col(x) == F.col(y))
            return df.select(*(F.col(c).alias(f"{alias}.{c}") for c in df.columns)), {alias}
        if kind in ("Nested Loop", "Merge Join"):
            raise PlanError(f"{kind} is not supported")
        if kind != "Hash Join":
            raise PlanError(f"unsupported node type {kind}")
        if len(below) != 2 or sum(x.get("Node Type") == "Hash" for x in below) != 1:
            raise PlanError("a hash join needs exactly one Hash child of two")
        (left, a), (right, b) = map(walk, below)
        pairs = query.graph.conditions(a, b)
        if not pairs:
            raise PlanError("no condition joins " + ", ".join(sorted(a | b)))
        if honour_build_side:
            left, right = (left.hint("shuffle_hash"), right) if below[0]["Node Type"] == "Hash" else (left, right.hint("shuffle_hash"))
        on = None
        for (x, c), (y, d) in pairs:
            pair = F.col(f"`{x}.{c}`") == F.col(f"`{y}.{d}`")
            on = pair if on is None else on & pair
        return left.join(right, on), a | b

    out, _ = walk(tree.get("Plan", tree))
    return out.select(*(F.col(f"`{a}.{c}`").alias(name) for (a, c), name in zip(query.outputs, query.names, strict=True)))
