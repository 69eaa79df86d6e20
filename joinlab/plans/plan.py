"""Positional plans of two node kinds, scan and inner equi-join, lowered to DataFrames.

Every scan and join renames its outputs to names of its own, so self-joins and repeated columns never
clash; Catalyst sees one declarative tree and prunes, pushes down and picks the join strategy.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scan:
    table: int
    outputs: tuple[int, ...]


@dataclass(frozen=True)
class Join:
    build_left: bool
    left: int
    right: int
    keys: tuple[tuple[int, int], ...]
    outputs: tuple[int, ...]


@dataclass
class Plan:
    """Nodes refer to one another, and to inputs, by number."""

    inputs: list[DataFrame] = field(default_factory=list)
    nodes: list[Scan | Join] = field(default_factory=list)
    root: int = -1

    def add_input(self, df: DataFrame) -> int:
        self.inputs.append(df)
        return len(self.inputs) - 1

    def scan(self, table: int, outputs) -> int:
        self.nodes.append(Scan(table, tuple(outputs)))
        self.root = len(self.nodes) - 1
        return self.root

    def join(self, build_left: bool, left: int, right: int, left_key, right_key, outputs) -> int:
        """One key pair, or lists of them."""
        many = zip(left_key, right_key, strict=True) if isinstance(left_key, (list, tuple)) else [(left_key, right_key)]
        self.nodes.append(Join(build_left, left, right, tuple(many), tuple(outputs)))
        self.root = len(self.nodes) - 1
        return self.root

    def execute(self, names=None, honour_build_side: bool = False, strict_keys: bool = False) -> DataFrame:
        out = self._lower(self.root, honour_build_side, strict_keys)
        return out.toDF(*(names or [f"c{i}" for i in range(len(out.columns))]))

    def _lower(self, at: int, honour: bool, strict: bool) -> DataFrame:
        node = self.nodes[at]
        if isinstance(node, Scan):
            df = self.inputs[node.table]
            df = df.toDF(*(f"t{at}_{i}" for i in range(len(df.columns))))
            return df.select(*(F.col(f"t{at}_{i}").alias(f"n{at}_{k}") for k, i in enumerate(node.outputs)))
        left, right = self._lower(node.left, honour, strict), self._lower(node.right, honour, strict)
        if not node.keys:
            raise ValueError("a join needs a key pair")
        if strict:
            for a, b in node.keys:
                if left.schema[a].dataType != right.schema[b].dataType:
                    raise TypeError(f"join keys differ in type: {left.schema[a].dataType} and {right.schema[b].dataType}")
        columns = left.columns + right.columns
        wrong = [i for i in node.outputs if not 0 <= i < len(columns)]
        if wrong:
            raise IndexError(f"join outputs out of range: {wrong}")
        if honour:
            left, right = (left.hint("shuffle_hash"), right) if node.build_left else (left, right.hint("shuffle_hash"))
        on = None
        for a, b in node.keys:
            pair = F.col(left.columns[a]) == F.col(right.columns[b])
            on = pair if on is None else on & pair
        return left.join(right, on, "inner").select(*(F.col(columns[i]).alias(f"n{at}_{k}") for k, i in enumerate(node.outputs)))
