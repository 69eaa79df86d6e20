"""Exact dedup: binary-fuse filters of an immutable snapshot screen the digests of a new batch.

1. Each row gets the SHA-256 of its whole text; the small digest table is stored in the shared folder.
2. The snapshot's distinct digests, cut into buckets of bounded size by a digest prefix, give one static
   binary-fuse filter a bucket; the filters are stored and never change.
3. The new batch is grouped by itself first. Its distinct digests meet the filter of their bucket:
   negatives are certainly new; positives join the snapshot's exact buckets.
4. Texts under a digest that occurs twice anywhere are compared byte for byte: they are grouped by (digest, salt,
   text), so a large group of copies meets in no single task, and then by (digest, text).

Of equal texts the row with the largest id stays. Defined results: a null text counts as empty; rows
repeated with the same id are all reported and one of them is kept (ties by id); null ids rank below all others;
very long texts are compared whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlab.llm import binary_fuse
from joinlab.llm.common import settings, store, table, whole_text

#: Digests that one filter holds at most, on average: 1.13 MB of filter.
BUCKET_KEYS = 1_000_000
#: Tasks that copies of one text are dealt over.
SALTS = 16


def _key64(digests: pd.Series) -> np.ndarray:
    """Bytes 8-16 of each digest; the bucket comes from its first bytes."""
    return np.frombuffer(b"".join(d[8:16] for d in digests), "<u8") if len(digests) else np.zeros(0, np.uint64)


def with_bucket(df: DataFrame, buckets: int) -> DataFrame:
    prefix = F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long")
    return df.withColumn("bucket", prefix % F.lit(buckets))


def build_filters(snapshot_groups: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket: bucket, filter. Expects distinct digests."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": pdf.bucket[:1], "filter": [binary_fuse.build(_key64(pdf.digest))]})

    return with_bucket(snapshot_groups.select("digest"), buckets).groupBy("bucket").applyInPandas(one, "bucket long, filter binary")


def screen(batch_groups: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The batch's distinct digests that their bucket's filter lets through."""

    def one(keys: pd.DataFrame, blob: pd.DataFrame) -> pd.DataFrame:
        if not len(keys) or not len(blob):
            return keys[["digest"]][:0]
        return keys.loc[binary_fuse.probe(blob["filter"].iloc[0], _key64(keys.digest)), ["digest"]]

    left = with_bucket(batch_groups.select("digest"), buckets).groupBy("bucket")
    return left.cogroup(filters.groupBy("bucket")).applyInPandas(one, "digest binary")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", incoming=None) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    ``incoming`` is a condition that tells the new batch from the snapshot; by default a hash of the id
    puts one half of the rows on either side, so that both paths carry load.
    """
    incoming = F.xxhash64(F.col(key)) % 2 == 0 if incoming is None else incoming
    new_row = F.coalesce(incoming, F.lit(True)).alias("new")
    rows = store(docs.select(F.col(key).alias("id"), F.unhex(F.sha2(whole_text(text), 256)).alias("digest"), new_row), "digests")
    groups = lambda part: part.groupBy("digest").agg(F.count("*").alias("n"))
    old, new = groups(rows.where("not new")), groups(rows.where("new"))
    # Buckets follow the larger side, so that neither a large snapshot nor a large batch makes large groups.
    sides = rows.groupBy("new").count().collect()
    buckets = max((r["count"] for r in sides), default=0) // BUCKET_KEYS + 16
    filters = store(build_filters(old, buckets), "filters")
    known = screen(new, filters, buckets).join(old.select("digest"), "digest")
    repeated = known.unionByName(old.where("n > 1").select("digest")).unionByName(new.where("n > 1").select("digest")).distinct()
    repeated = store(repeated, "repeated")
    # Copies of one text are dealt over SALTS tasks; each sends one row a text on.
    salt = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(SALTS)).alias("salt")
    texts = docs.select(F.col(key).alias("id"), whole_text(text).alias("body"), salt).withColumn("digest", F.unhex(F.sha2("body", 256)))
    dealt = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    # Hashed up to this size, else sorted; never broadcast, so that the plan of a small table is that of a large one.
    plan = {"spark__sql__adaptive__maxShuffledHashJoinLocalMapThreshold": "32m", "spark__sql__autoBroadcastJoinThreshold": "-1"}
    with settings(docs.sparkSession, **plan):
        part = store(texts.join(dealt, ["digest", "salt"]).groupBy("digest", "salt", "body").agg(F.max("id").alias("keep_id"), F.count("*").alias("n")), "parts")
    same = part.groupBy("digest", "body").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    # Stored, so that the join below has an exchange on both sides and a hot digest can be split.
    same = store(same.select("digest", "keep_id", "group_size"), "groups")
    # Copies with one id collapse to one row with a count, so exactly one of them can be the kept one.
    each = rows.groupBy("id", "digest").agg(F.count("*").alias("copies")).join(same, "digest", "left")
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return each.select(
        F.col("id").alias(key),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("id").eqNullSafe(keep) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE = """
WITH g AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM g)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM m
"""
