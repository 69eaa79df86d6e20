"""A corpus pipeline of five stages; each works on all that the one before kept and is written as Parquet.

Stages but the last return the columns of ``documents``. SQL cannot express the classifier, the fingerprints or the
tokenizer, so ORACLE_SQL is None and tests hold each stage against a plain version.

Defined results: ids are expected to be unique; rows with one id share the fate that stage 3 gives to the id (stages 1
and 4 take every row by itself). Null and empty texts pass or fail stage 1 by the score of an empty
text, are one text in stages 2 and 3, and leave in stage 4, as a mix takes words and they have none. Rows with a null id
leave stage 3 if all of them are near duplicates of rows with ids; very long texts are read whole; an empty table
gives empty results; tables with more columns than ``documents`` keep them up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from joinlab.llm import exact_dedup, mixing, packing, rule_ensemble, simhash
from joinlab.llm.common import partitions, store, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go, null ids too; without usable labels all stay."""
    return rule_ensemble.accepted(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, the one with the largest id."""
    kept = exact_dedup.exact_dedup(docs).where("kept").select(F.col("doc_id").alias("k_id"), F.col("text_sha256").alias("k_sha"))
    rows = docs.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("sha") == F.col("k_sha")), "left_semi")
    once = W.partitionBy("doc_id", "sha").orderBy("n_chars")
    return rows.withColumn("copy", F.row_number().over(once)).where("copy = 1").select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (Jaccard 0.8 or more on five-word shingles) the document with the smallest id stays.
    Links of the SimHash trees are confirmed on the shingles, and a join on the shingles adds those that no radius of
    SimHash covers; op7 has its own numbers."""
    kept = simhash.near_duplicates(docs, shingle=5, confirmed=True).where("doc_id <=> component_id").select(F.col("doc_id").alias("k_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("k_id")), "left_semi").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it; the one where a source's target ends counts as whole if at
    least half of it is taken. Rows of an output shard lie together in a random order."""
    fields = [F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit("n")) for c in docs.columns]
    rows = docs.withColumn("row", F.sha2(F.concat_ws(":", *fields), 256))
    takes = mixing.mix(rows, keep=("row",)).select("row", "size", F.explode("takes").alias("take")).where("2 * take.words >= size")
    # Rows that are equal in all columns share their takes, so one of them stands for all.
    once = W.partitionBy("row").orderBy("n_chars")
    rows = rows.withColumn("copy", F.row_number().over(once)).where("copy = 1").join(takes, "row")
    slices = max(8, partitions(spark) // mixing.SHARDS)  # slices of a shard, so that partitions stay small at any size
    shuffled = rows.repartition("take.shard", F.pmod(F.col("take.place"), F.lit(slices))).sortWithinPartitions("take.shard", "take.place")
    return shuffled.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: the columns of packing.PIECES."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing sources", mix), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
