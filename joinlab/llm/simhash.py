"""SimHash near-dedup with vantage-point trees over the fingerprints.

Fingerprints: 64 bits by majority over the XXH64 (seed 42) of word shingles.

Pairs: a Hamming distance is the sum of the distances on disjoint slices of the bits, so two fingerprints
within k bits are within ``k // m`` on one of m slices, and equal on m - k of them if m is larger than k. For every
choice of so many slices a vantage-point tree cuts the fingerprints into shards: at each level a vantage point's slice and the median distance to it decide, and
by the triangle bound only branches within the slice's radius of the boundary need the point too
(with m over k that radius is 0 and no point is copied). Inside a shard a vantage-point tree over all
64 bits prunes branches by triangle bounds, and points near a boundary (within k) meet across it, so all
pairs within k bits are found. A shard returns a spanning forest of its links, never all pairs; a shard
over ``shard_rows`` is cut into chunks and every pair of chunks becomes a task.

Vantage points and medians come from a bounded sample; they steer balance only, never results.

Defined results: null texts count as empty; texts without words have fingerprint zero, which links like
any other; repeated rows are all reported; null ids are ignored when the smallest id is sought; equal
fingerprints (ties) are one point; very long texts are hashed whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlab.llm.common import small_batches, store, table, whole_text
from joinlab.llm.components import connected_components
from joinlab.llm.components import roots as _roots

BITS = 64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(raw: bytes, shingle: int = 4) -> int:
    words = raw.translate(_LOWER).split()
    if not words:
        return 0
    text, n = b" ".join(words), len(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        hashes = [digest(text, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[: n - shingle] + 1)).tolist()
        hashes = [digest(text[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    return majority(np.array(hashes, "<u8"))


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 4096):
        counts += np.unpackbits(h[at : at + 4096].view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """id and fp, the fingerprint as a signed long."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(v.as_py().encode(), shingle) for v in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["id", "fp"])

    return docs.select(F.col(key).alias("id"), whole_text(text).alias("t")).mapInArrow(run, f"id {kind}, fp long")


def _distance(a, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _cross(fp: np.ndarray, a: np.ndarray, b: np.ndarray, k: int, out: list, size: int = 512) -> None:
    """All links between index sets a and b (the same set: each pair once), compared in blocks."""
    same = a is b
    for i in range(0, len(a), size):
        rows = a[i : i + size]
        for j in range(i if same else 0, len(b), size):
            cols = b[j : j + size]
            x, y = np.nonzero(_distance(fp[rows][:, None], fp[cols][None]) <= k)
            if same and i == j:
                x, y = x[x < y], y[x < y]
            if len(x):
                both, inverse = np.unique(np.concatenate([rows[x], cols[y]]), return_inverse=True)
                root = _roots(len(both), inverse[: len(x)], inverse[len(x) :])
                child = np.flatnonzero(root != np.arange(len(both)))
                out.append((both[root[child]], both[child]))


def shard_links(fp: np.ndarray, k: int, leaf: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that span every component of the links within distance k, by a vantage-point tree."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [np.arange(len(fp))]
    while stack:
        own = stack.pop()
        if len(own) <= leaf:
            _cross(fp, own, own, k, out)
            continue
        d = _distance(fp[own], fp[own[len(own) // 2]]).astype(np.int64)
        cut = int(np.median(d))
        if cut == d.max():
            cut -= 1
        inside = d <= cut
        if not inside.any() or (near := (d > cut - k) & (d <= cut + k)).mean() > 0.9 and len(own) <= 8 * leaf:
            _cross(fp, own, own, k, out)  # nothing to prune
            continue
        stack += [own[inside], own[~inside]]
        # Across the boundary only distances that differ by k at most can belong to a link.
        for step in range(cut - k + 1, cut + 1):
            a, b = own[d == step], own[(d > cut) & (d <= step + k)]
            if len(a) and len(b):
                _cross(fp, a, b, k, out)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    root = _roots(len(fp), a, b)
    child = np.flatnonzero(root != np.arange(len(fp)))
    return root[child], child


def slices(m: int) -> list[tuple[int, int]]:
    """(shift, width) of m slices that cover 64 bits."""
    edges = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def intact(n: int, k: int) -> int:
    """Slices, of one more each time than k, that must agree: more as there are more fingerprints, so that shards stay
    small (at k = 4: one of 5 slices up to 8 million, two of 6 up to 2 billion, three of 7 beyond)."""
    return 1 if n <= 1 << 23 else 2 if n <= 1 << 31 else 3


def plant_trees(sample: np.ndarray, k: int, m: int, depth: int, seed: int = 1) -> list[dict]:
    """For each choice of m - k slices (of one, if m is k or less) its mask, radius and, for each level, a vantage point
    and the median distance to it."""
    rng, trees = np.random.default_rng(seed), []
    for chosen in itertools.combinations(slices(m), max(1, m - k)):
        mask = np.uint64(sum(((1 << width) - 1) << shift for shift, width in chosen))
        part = sample & mask
        levels = []
        for _ in range(depth):
            v = rng.choice(part) if len(part) else np.uint64(0)
            v = (v ^ np.uint64(int(rng.integers(0, 2**63)))) & mask  # sampled points alone would cluster
            levels.append((v, int(np.median(_distance(part, v))) if len(part) else 8))
        trees.append({"mask": mask, "radius": k // m, "levels": levels})
    return trees


def shards_of(fp: np.ndarray, trees: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, tree, shard); a point within the radius of a boundary goes to both sides."""
    rows, which, codes = [], [], []
    for t, tree in enumerate(trees):
        at, code, part = np.arange(len(fp)), np.zeros(len(fp), np.int64), fp & tree["mask"]
        for v, cut in tree["levels"]:
            d, r = _distance(part[at], v).astype(np.int64), tree["radius"]
            inside, outside = d - r <= cut, d + r > cut
            at, code = np.concatenate([at[inside], at[outside]]), np.concatenate([code[inside] * 2, code[outside] * 2 + 1])
        rows.append(at)
        which.append(np.full(len(at), t, np.int32))
        codes.append(code)
    return np.concatenate(rows), np.concatenate(which), np.concatenate(codes)


def links(unique: DataFrame, k: int, m: int | None = None, shard_rows: int = 20_000, target: int = 1024, sample_rows: int = 4096) -> DataFrame:
    """unique: fp (distinct longs). Returns a, b: links that span every component."""
    n = unique.count()
    m = m or k + intact(n, k)
    depth = min(32, max(0, math.ceil(math.log2(max(n, 1) / target))))
    sample = unique.orderBy(F.xxhash64("fp")).limit(sample_rows).toPandas().fp.to_numpy(np.int64).view(np.uint64)
    trees = plant_trees(np.sort(sample), k, m, depth)

    def place(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            at, tree, code = shards_of(fp.view(np.uint64), trees)
            yield pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(tree), pa.array(code)], names=["fp", "tree", "shard"])

    placed = store(unique.select("fp").mapInArrow(place, "fp long, tree int, shard long"), "shards")
    chunks = placed.groupBy("tree", "shard").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("chunks")).where("chunks > 1")
    cut = placed.join(chunks, ["tree", "shard"], "left").withColumns({"chunks": F.coalesce("chunks", F.lit(1))})
    cut = cut.withColumn("own", F.pmod(F.xxhash64("fp"), "chunks").cast("int"))
    # Chunk i of n takes part in the tasks (i, j) and (j, i) of all j, so any two rows meet in one task.
    pairs = F.expr("transform(sequence(0, chunks - 1), j -> named_struct('i', least(own, j), 'j', greatest(own, j)))")
    tasks = cut.withColumn("task", F.explode(pairs)).select("tree", "shard", "task.i", "task.j", "fp")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf.fp.to_numpy(np.int64)
        a, b = shard_links(fp.view(np.uint64), k)
        return pd.DataFrame({"a": fp[a], "b": fp[b]})

    return tasks.groupBy("tree", "shard", "i", "j").applyInPandas(one, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, max_bits: int = 4, confirmed: bool = False, **options) -> DataFrame:
    """One row per input row: key, fingerprint, component_id.

    ``confirmed`` asks for the links of Jaccard 0.8 or more on the shingle sets instead: links of the trees are
    confirmed on the sets, and an exact join of the sets adds those that lie beyond ``max_bits`` (no radius of a
    fingerprint covers a similarity); the columns are then key and component_id."""
    if confirmed:
        from joinlab.llm import near_jaccard

        return near_jaccard.near_duplicates(docs, key, text, shingle, max_bits=max_bits, **options)
    small_batches(docs.sparkSession)
    rows = store(fingerprints(docs, key, text, shingle), "fingerprints")
    unique = store(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "unique")
    roots = connected_components(links(unique, max_bits, **options))
    named = unique.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = store(named, "named")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    component = store(named.join(least, "root").select("fp", "component_id"), "component")
    return rows.join(component, "fp").select(
        F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
