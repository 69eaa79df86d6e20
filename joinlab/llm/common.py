"""Helpers shared by the corpus operators: reading tables, shared scratch folders, words."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of bytes outside ASCII white space; ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One input table, cut to the columns that are needed (the scan then reads no others)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local master may leave it unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(spark, "_joinlab_scratch"):
        spark._joinlab_scratch = tempfile.mkdtemp(prefix="joinlab-")
    return spark._joinlab_scratch


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/joinlab-{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings (dots written as two underscores) that end with the block."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def store(df: DataFrame, label: str) -> DataFrame:
    """Writes a DataFrame to the shared folder and reads it back: lineage ends there, lost executors cost nothing.
    Spark deletes the shuffle files of the step when it ends."""
    path = scratch(df.sparkSession, label)
    with settings(df.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._joinlab_path = path
    return out


def drop_stored(*stored: DataFrame) -> None:
    """Deletes the files of stored DataFrames that nothing will read again."""
    for df in stored:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._joinlab_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Long documents make large Arrow batches; fewer rows a batch bound a Python worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def whole_text(text: str = "text") -> F.Column:
    return F.coalesce(F.col(text), F.lit(""))


def ascii_lower(col: F.Column) -> F.Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
