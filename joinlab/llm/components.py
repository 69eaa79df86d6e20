"""Connected components by repeated contraction; every step is a DataFrame join and is stored.

Edges shrink with every round. Once ``TOGETHER`` of them or fewer are left, one task ends them all in its memory: each
round costs the driver several queries with their threads, and small rounds gain nothing from more tasks."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinlab.llm.common import store

#: Edges up to which one task takes all that is left: two longs each, some 20 MB in memory.
TOGETHER = 1 << 18


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component, by hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def _together(batches):
    """One task's edges a, b: node and the smallest node of its component."""
    columns = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    if columns:
        a, b = (np.concatenate(x) for x in zip(*columns, strict=True))
        nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
        ends = nodes[roots(len(nodes), places[: len(a)], places[len(a) :])]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(ends)], names=["node", "to"])


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", together: int = TOGETHER) -> DataFrame:
    """edges: two long columns. Returns node, root: nodes with an edge, equal roots for connected ones.

    In each round every node moves to the neighbour (or itself) with the smallest hash drawn for that
    round. Edges are renamed, loops and repeats dropped; a constant share of the nodes goes each round, so
    a chain of any length ends after a logarithmic number of rounds."""
    edges = store(edges.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).where("a <> b").distinct(), "edges")
    moves = []
    for k in itertools.count():
        n = edges.count()
        if not n:
            break
        if n <= together:
            moves.append(store(edges.select("a", "b").coalesce(1).mapInArrow(_together, "node long, to long"), "moves"))
            break
        both = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")))))
        draw = lambda c: F.struct(F.xxhash64(F.lit(k), F.col(c)), F.col(c).alias("id"))
        move = both.groupBy("node").agg(F.min(draw("near")).alias("near")).select("node", F.least(draw("node"), "near")["id"].alias("to"))
        move = store(move, "moves")
        moves.append(move)
        a, b = move.select(F.col("node").alias("a"), F.col("to").alias("a2")), move.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        new = edges.join(a, "a").join(b, "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).where("a <> b")
        edges = store(new.distinct(), "edges")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # Later moves first: each table in turn maps its targets on to where those ended.
    ends = moves[-1].select("node", F.col("to").alias("root"))
    for move in reversed(moves[:-1]):
        nxt = ends.select(F.col("node").alias("to"), F.col("root"))
        ends = store(move.join(nxt, "to", "left").select("node", F.coalesce("root", "to").alias("root")), "roots")
    return ends
