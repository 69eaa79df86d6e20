"""Substring dedup with a log-structured fingerprint index.

Index: runs, each an immutable table bucketed by fingerprint and sorted inside its buckets, one file a
bucket. A new batch becomes a run; it is merge-joined with every earlier run, bucket by bucket and without
a shuffle; whenever the newest runs have grown to the size of their elder, they are compacted into one.

Fingerprints: a window of ``window`` words is represented by its anchor, the smallest hash of the ``group``
word groups inside it. Equal windows have equal anchors, so fingerprints that only one document has rule out
most windows. Verification: documents that share an anchor give two 64-bit hashes of the whole window, over different
hashes of its words, for each such anchor; the smallest id for both together decides, so a false match needs both to
collide at once (or two words of one 64-bit hash).

A word goes if a window over it also starts in a document with a smaller id, judged on the input. Defined
results: null texts have no words; texts shorter than a window lose nothing; rows with one id count as
one document whose windows do not repeat each other, so repeated rows are treated alike; rows with a null
id are neither searched nor cut; ids may be of any type with an order (strings by code point); very long texts are read
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlab.llm.common import drop_stored, partitions, settings, small_batches, store, table, whole_text
from joinlab.llm.windows import anchors, other_hashes, window_hashes, word_hashes

WINDOW, GROUP = 13, 6


class FingerprintIndex:
    """Sorted immutable runs of (fp, id); ``add`` returns the postings whose fingerprint is now shared.

    An index with a name outlives its session if the catalogue does: opened again, it goes on from its runs. Its
    number of buckets must stay the same. One without a name is dropped by ``close``."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, name: str | None = None):
        self.spark, self.buckets, self.name = spark, buckets or partitions(spark), name
        self.runs: list[tuple[str, int]] = []  # table, generation
        if name:  # the table's name holds the run's number and generation
            found = [t.name for t in spark.catalog.listTables() if t.name.startswith(f"joinlab_{name}_")]
            self.runs = [(t, int(t.split("_")[-2])) for t in sorted(found, key=lambda t: int(t.split("_")[-3]))]
        self.made = 1 + max((int(t.split("_")[-3]) for t, _ in self.runs), default=0) if name else 0

    def _write(self, postings: DataFrame, generation: int = 0) -> str:
        name = f"joinlab_{self.name or 'run'}_{self.made}_{generation}_{uuid.uuid4().hex}"
        self.made += 1
        rows = postings.repartition(self.buckets, "fp").sortWithinPartitions("fp", "id")
        rows.write.option("compression", "zstd").bucketBy(self.buckets, "fp").sortBy("fp").saveAsTable(name)
        return name

    def add(self, postings: DataFrame) -> list[DataFrame]:
        """postings: fp, id without repeats."""
        # A bucket is one sorted file, so its order can be used as it is.
        with settings(self.spark, spark__sql__legacy__bucketedTableScan__outputOrdering="true"):
            return self._add(postings)

    def _add(self, postings: DataFrame) -> list[DataFrame]:
        name = self._write(postings)
        run, out = self.spark.table(name), []
        twice = run.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
        out.append(store(run.join(twice.hint("merge"), "fp", "left_semi"), "shared"))
        for other, _ in self.runs:
            past = self.spark.table(other)
            out.append(store(run.join(past.hint("merge"), "fp", "left_semi"), "shared"))
            out.append(store(past.join(run.hint("merge"), "fp", "left_semi"), "shared"))
        self.runs.append((name, 0))
        while len(self.runs) > 1 and self.runs[-1][1] >= self.runs[-2][1]:
            (b, g), (a, _) = self.runs.pop(), self.runs.pop()
            self.runs.append((self._write(self.spark.table(a).unionByName(self.spark.table(b)), g + 1), g + 1))
            self._drop(a, b)
        return out

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        """Drops an index without a name; one with a name stays."""
        if not self.name:
            self.drop()

    def drop(self) -> None:
        self._drop(*(name for name, _ in self.runs))
        self.runs = []


def postings_of(docs: DataFrame, window: int, group: int) -> DataFrame:
    """docs: id, t. Returns fp, id, each pair once."""

    def run(batches):
        for b in batches:
            fps = [np.unique(anchors(word_hashes(v.as_py().encode()), window, group)) for v in b.column(1)]
            n = np.fromiter(map(len, fps), np.int64, len(fps))
            at = np.repeat(np.arange(len(fps)), n)
            fp = np.concatenate(fps).view(np.int64) if len(fps) else np.zeros(0, np.int64)
            for lo in range(0, len(fp), 1 << 20):
                part = slice(lo, lo + (1 << 20))
                yield pa.RecordBatch.from_arrays([pa.array(fp[part]), b.column(0).take(pa.array(at[part]))], names=["fp", "id"])

    return docs.mapInArrow(run, f"fp long, id {docs.schema['id'].dataType.simpleString()}")


def _among(x: np.ndarray, few: pa.Scalar) -> np.ndarray:
    """Which values stand in an Arrow list of signed longs; the list is short, so only it is sorted."""
    own = np.sort(few.values.to_numpy(zero_copy_only=False).view(np.uint64))
    return own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x if len(own) else np.zeros(len(x), bool)


def _key(h: np.ndarray, a: np.ndarray, window: int) -> np.ndarray:
    """The first key of every window, of its anchor and its first hash."""
    x = (a * np.uint64(0xD6E8FEB86659FD93)) ^ window_hashes(h, window)
    return x ^ (x >> np.uint64(31))


def repeated_windows(candidates: DataFrame, window: int, group: int) -> DataFrame:
    """candidates: id, t, fps (the shared anchors of the document). Returns id, keys: hashes of the windows
    that also start in a document with a smaller id."""

    def run(batches):
        for b in batches:
            keys = []
            for t, fps in zip(b.column(1), b.column(2), strict=True):
                h = word_hashes(t.as_py().encode())
                a = anchors(h, window, group)
                on = _among(a, fps)
                keys.append((_key(h, a, window)[on], other_hashes(h, window)[on]))
            at = np.repeat(np.arange(len(keys)), np.fromiter((len(k) for k, _ in keys), np.int64, len(keys)))
            both = [np.concatenate(x).view(np.int64) if len(keys) else np.zeros(0, np.int64) for x in (zip(*keys, strict=True) if keys else ((), ()))]
            yield pa.RecordBatch.from_arrays([*map(pa.array, both), b.column(0).take(pa.array(at))], names=["key", "other", "id"])

    kind = candidates.schema["id"].dataType.simpleString()
    rows = store(candidates.mapInArrow(run, f"key long, other long, id {kind}"), "windows")
    # Pre-aggregated on the map side: a passage of very many documents sends a row a task.
    first = rows.groupBy("key", "other").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("key", "other", "first")
    first = store(first, "first")
    gone = store(rows.join(first, ["key", "other"]).where("id > first").groupBy("id").agg(F.collect_list("key").alias("keys")), "repeated")
    drop_stored(rows, first)
    return gone


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, group: int = GROUP, batches: int = 3, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """One row per input row: key, n_words, n_removed, kept (the words that stay, joined by one space), kept_sha256.

    ``index`` goes on from an index of earlier documents and takes these in; ``history`` then holds those documents
    (key, text), as candidates are verified on texts."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).alias("id"), whole_text(text).alias("t"))
    index, shared = index or FingerprintIndex(spark), []
    for k in range(batches):
        batch = rows.where(F.col("id").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(batches)) == k))
        shared += index.add(postings_of(batch, window, group).distinct())
    index.close()
    hits = shared[0]
    for s in shared[1:]:
        hits = hits.unionByName(s)
    per_doc = store(hits.groupBy("id").agg(F.collect_set("fp").alias("fps")), "anchors")
    drop_stored(*shared)
    known = rows if history is None else rows.unionByName(history.select(F.col(key).alias("id"), whole_text(text).alias("t")))
    gone = repeated_windows(known.join(per_doc, "id").select("id", "t", "fps"), window, group)
    drop_stored(per_doc)

    def run(batches_):
        for b in batches_:
            n, cut, kept = [], [], []
            for t, keys in zip(b.column(1), b.column(2), strict=True):
                raw = t.as_py().encode()
                words = raw.split()
                drop = np.zeros(len(words) + 1, np.int64)
                if keys.is_valid and len(words) >= window:
                    h = word_hashes(raw)
                    on = np.flatnonzero(_among(_key(h, anchors(h, window, group), window), keys))
                    drop[on] += 1
                    drop[on + window] -= 1
                stay = np.cumsum(drop)[:-1] == 0
                n.append(len(words))
                cut.append(int((~stay).sum()))
                kept.append(b" ".join(words if stay.all() else [w for w, s in zip(words, stay, strict=True) if s]))
            sha = [hashlib.sha256(x).hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array([x.decode() for x in kept]), pa.array(sha)], names=["id", "n_words", "n_removed", "kept", "kept_sha256"])

    out = rows.join(gone, "id", "left").select("id", "t", "keys").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_removed long, kept string, kept_sha256 string")
    return out.withColumnRenamed("id", key)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents", "doc_id", "text")).drop("kept")
