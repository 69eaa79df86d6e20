"""Near duplicates by Jaccard similarity of word shingles: an exact set-similarity join.

Documents with the same set of shingles are one unit. With its shingles in the order of their hashes, at most
``n - ceil(0.8 n)`` of a unit are missing in a partner, so among the first ``n - ceil(0.8 n) + extra(n)`` of both at
least the smaller ``extra`` are common; a partner has 0.8 n shingles or more, so a unit that shares fewer than
``extra(ceil(0.8 n))`` of them has no partner and goes. Over the units that stay, shingles are ordered by how many
units hold them, rare ones first; two units that meet the threshold share one of the first
``n - ceil(0.8 n) + 1`` shingles (the prefix). Size, positional and bitmap filters follow; candidates are verified on whole sets, in whole numbers:
9 |A and B| >= 4 (|A| + |B|) is Jaccard >= 4 / 5.

Links that SimHash finds (``simhash.links``: vantage-point trees over fingerprints of the same shingles) are verified on
the sets first, so most near copies are one component before the join begins.

Only components are wanted, so groups that share a prefix shingle meet some of their own as centres first, for some
rounds with other centres while the pairs left are many (a round's rows grow as the prefixes, not as their squares);
pairs across components are then verified all, so the result is exact up to a collision of 64-bit hashes.

Defined results: null texts count as empty; texts without words are near duplicates of each other; null ids are ignored
when the smallest id is sought; repeated rows are all reported; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from joinlab.llm.common import drop_stored, settings, small_batches, store, whole_text
from joinlab.llm.components import connected_components
from joinlab.llm.simhash import _LOWER, majority
from joinlab.llm.simhash import links as tree_links

SHINGLE = 5
#: Rounds of centres at most, and centres of a group. The first round comes with more than one pair a prefix row, others
#: with more than ``PAIRS``, unless one left more than half of the pairs: those documents share passages and are not similar.
ROUNDS, CENTRES, PAIRS = 6, 16, 16
#: Shingles that a set of n may miss in a partner, and those of the first filter beyond them.
MISSING, EXTRA = "(n - (4 * n + 4) div 5)", "(1 + {n} div 20)"

#: The bitmap of a set: a bit for each value of the low bits of a hash, flipped by every shingle that has it. Two sets
#: differ in at least as many shingles as their bitmaps in bits.
MAP, MAP_BITS = tuple(f"m{k}" for k in range(8)), 512
#: Shingles that two sets of n and b_n must share.
SHARE = "((4 * (n + b_n) + 8) div 9)"


def shingle_hashes(raw: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles, A-Z lower-cased, repeats included; texts of fewer words are one shingle."""
    words = raw.translate(_LOWER).split()
    text, n, digest = b" ".join(words), len(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([digest(text, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - shingle] + 1)).tolist()
    return np.array([digest(text[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def shingle_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, unit (a hash of the set), n, the fingerprint fp, the bitmap (MAP) and the sorted set itself as hs."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            hashes = [shingle_hashes(v.as_py().encode(), shingle) for v in b.column(1)]
            if not hashes:
                continue
            sets = [np.unique(h) for h in hashes]
            fp = np.array([majority(h) for h in hashes], np.uint64).view(np.int64)
            unit = np.maximum(np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64), 1 - 2**63)
            n = np.array([len(s) for s in sets], np.int32)
            bits = np.packbits(np.stack([np.bincount((s & np.uint64(MAP_BITS - 1)).astype(np.int64), minlength=MAP_BITS) & 1 for s in sets]).astype(np.uint8), axis=1).view(np.int64)
            hs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(unit), pa.array(n), pa.array(fp), *(pa.array(bits[:, k].copy()) for k in range(len(MAP))), hs], names=["id", "unit", "n", "fp", *MAP, "hs"])

    return docs.select(F.col(key).alias("id"), whole_text(text).alias("t")).mapInArrow(run, f"id {kind}, unit long, n int, fp long, {', '.join(f'{m} long' for m in MAP)}, hs array<long>")


def staying_sets(rows: DataFrame, units: DataFrame) -> DataFrame:
    """unit, n, the bitmap and hs of the units that the first filter leaves."""
    first = rows.select("unit", F.explode(F.expr(f"slice(hs, 1, cast({MISSING} + {EXTRA.format(n='n')} AS int))")).alias("h"))
    alone = first.groupBy("h").agg(F.min("unit").alias("unit"), F.max("unit").alias("other")).where("unit = other").groupBy("unit").agg(F.count("*").alias("alone"))
    shared = f"{MISSING} + {EXTRA.format(n='n')} - coalesce(alone, 0)"
    staying = store(units.join(alone, "unit", "left").where(f"{shared} >= {EXTRA.format(n='((4 * n + 4) div 5)')}").select("unit"), "staying")
    # Sets are large, so a runtime Bloom filter of the units (Spark bounds its size) drops most before they move; the
    # condition, which holds for all, tells Spark that the list is worth a filter.
    staying = staying.where(f"unit >= {-(2**63) + 1}")
    with settings(rows.sparkSession, spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold="0"):
        return store(rows.join(staying, "unit", "left_semi").groupBy("unit").agg(*(F.first(c).alias(c) for c in ("n", *MAP, "hs"))), "staying-sets")


def prefixes(sets: DataFrame) -> DataFrame:
    """h, unit, n, at (its place in the unit's order) and the bitmap: the shingles of each unit's prefix that another
    unit holds too."""
    rows = sets.select("unit", "n", F.explode("hs").alias("h"))
    held = rows.join(rows.groupBy("h").agg(F.count("*").alias("df")), "h")
    ranked = held.withColumn("at", F.row_number().over(W.partitionBy("unit").orderBy("df", "h")))
    return ranked.where(f"at <= {MISSING} + 1 AND df > 1").select("h", "unit", "n", "at").join(sets.select("unit", *MAP), "unit")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose sets have Jaccard 0.8 or more."""
    a, b = (sets.select(F.col("unit").alias(x), F.col("n").alias(f"n{x}"), F.col("hs").alias(f"h{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").where("9 * size(array_intersect(ha, hb)) >= 4 * (na + nb)").select("a", "b")


def fingerprint_pairs(units: DataFrame, sets: DataFrame, max_bits: int) -> DataFrame:
    """units: unit, fp. The pairs a, b that vantage-point trees or equal fingerprints propose, verified."""
    unique = store(units.groupBy("fp").agg(F.min("unit").alias("unit")), "unique")
    one, two = unique.toDF("a", "unit_a"), unique.toDF("b", "unit_b")
    near = tree_links(unique, max_bits).join(one, "a").join(two, "b").select(F.col("unit_a").alias("a"), F.col("unit_b").alias("b"))
    same = units.select("fp", F.col("unit").alias("b")).join(unique.withColumnRenamed("unit", "a"), "fp").where("a <> b").select("a", "b")
    pairs = near.unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return store(verified(pairs, sets), "links")


def links(sets: DataFrame, known: DataFrame | None = None, rounds: int = ROUNDS, most: int = PAIRS) -> list[DataFrame]:
    """sets: unit (distinct), n, the bitmap, hs; known: verified pairs. Tables of pairs a, b that together span every component."""
    prefix, found = store(prefixes(sets), "prefix"), [] if known is None else [known]
    rows = prefix.count()

    def located() -> DataFrame:
        if not found:
            return store(prefix.withColumn("root", F.col("unit")), "placed")
        roots = connected_components(union(found)).withColumnRenamed("node", "unit")
        return store(prefix.join(roots, "unit", "left").withColumn("root", F.coalesce("root", "unit")), "placed")

    # The size filter, the positional filter (what can be shared from this place on), the bitmap filter.
    apart = " + ".join(f"bit_count({m} ^ b_{m})" for m in MAP)
    fits = f"5 * least(n, b_n) >= 4 * greatest(n, b_n) AND least(n - at, b_n - b_at) + 1 >= {SHARE} AND {apart} <= n + b_n - 2 * {SHARE}"
    other = lambda df: df.select("h", *(F.col(c).alias(f"b_{c}") for c in ("unit", "n", "root", "at", *MAP)))
    placed, left = located(), math.inf
    for k in range(rounds):
        own = placed.groupBy("h", "root").agg(F.count("*").alias("n")).groupBy("h").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
        before, left = left, own.agg(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()[0] or 0
        if left <= (most if k else min(most, 1)) * rows or left > before / 2:
            break
        drawn = F.row_number().over(W.partitionBy("h").orderBy(F.xxhash64(F.lit(k), "unit"), "unit"))
        centres = other(placed.withColumn("drawn", drawn).where(f"drawn <= {CENTRES}"))
        pairs = placed.join(centres, "h").where(f"root <> b_root AND {fits}")
        found.append(store(verified(pairs.select(F.least("unit", "b_unit").alias("a"), F.greatest("unit", "b_unit").alias("b")).distinct(), sets), "links"))
        drop_stored(placed)
        placed = located()
    pairs = placed.join(other(placed), "h").where(f"unit < b_unit AND root <> b_root AND {fits}")
    found.append(store(verified(pairs.select(F.col("unit").alias("a"), F.col("b_unit").alias("b")).distinct(), sets), "links"))
    drop_stored(prefix, placed)
    return found


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = 4, **options) -> DataFrame:
    """One row per input row: key, component_id, the smallest id of all documents that links of Jaccard 0.8 connect."""
    small_batches(docs.sparkSession)
    rows = store(shingle_sets(docs, key, text, shingle), "sets")
    ids = store(rows.select("id", "unit", "n", "fp"), "ids")
    units = store(ids.groupBy("unit").agg(F.first("n").alias("n"), F.min("id").alias("first_id"), F.min("fp").alias("fp")), "units")
    sets = staying_sets(rows, units)
    drop_stored(rows)
    roots = connected_components(union(links(sets, fingerprint_pairs(units, sets, max_bits), **options)))
    named = store(units.join(roots.withColumnRenamed("node", "unit"), "unit", "left").withColumn("root", F.coalesce("root", "unit")), "named")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    component = store(named.join(least, "root").select("unit", "component_id"), "component")
    return ids.select("id", "unit").join(component, "unit").select(F.col("id").alias(key), "component_id")
