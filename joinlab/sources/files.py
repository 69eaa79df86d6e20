"""CSV and Parquet sources and sinks, and the printed row format."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, schema: T.StructType, path: str, sep: str = ",", escape: str = "\\", header: bool = False, trailing_sep: bool = False, multi_line: bool = True, check_quotes: bool = True) -> DataFrame:
    """Typed CSV; empty fields, quoted or not, are NULL; malformed rows raise. With ``multi_line`` line feeds
    may stand inside quotes, at the price that a file is read by one task. A quote that is never closed raises when the
    file is opened: it would make one value of all that follows. That costs a pass; ``check_quotes`` false leaves it out."""
    if check_quotes and not (unclosed := _unclosed(spark.read.text(path, wholetext=multi_line), escape)).isEmpty():
        raise ValueError(f"a quote is not closed: {unclosed.first()[0][:80]!r}")
    full = T.StructType([*schema.fields, T.StructField("__trailing", T.StringType())]) if trailing_sep else schema
    df = spark.read.schema(full).csv(path, sep=sep, quote='"', escape=escape, header=header, multiLine=multi_line, mode="FAILFAST", nullValue="", emptyValue="")
    df = df.select(*(F.when(F.col(f.name) == "", None).otherwise(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in schema.fields))
    return df


def _unclosed(texts: DataFrame, escape: str) -> DataFrame:
    """The texts (files, or lines if none spans two) with an odd number of quotes that no escape sign takes away."""
    plain = F.regexp_replace("value", r"(?s)\\." if escape == "\\" else f"(?s){re.escape(escape)}." if escape != '"' else "a^", "")
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))
    return texts.where(quotes % 2 == 1)


def write_csv(df: DataFrame, path: str, sep: str = ",", escape: str = "\\", trailing_sep: bool = False) -> None:
    out = df.withColumn("__trailing", F.lit(None).cast("string")) if trailing_sep else df
    out.write.csv(path, sep=sep, quote='"', escape=escape, nullValue="", emptyValue="", header=False)


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the whole cluster shares; only a local master may leave it unset."""
    import tempfile

    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or tempfile.gettempdir()
    return f"{base}/joinlab-{label}-{uuid.uuid4().hex}"


def cached(df: DataFrame, path: str) -> DataFrame:
    """Writes the table as Parquet and reads it back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _printed(name: str, kind: T.DataType) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            c = F.replace(c, F.lit(old), F.lit(new))
        c = F.concat(F.lit('"'), c, F.lit('"'))
    return F.coalesce(c.cast("string"), F.lit("NULL"))


def format_rows(df: DataFrame) -> DataFrame:
    """One string a row: values joined by ``|``, strings quoted and escaped, NULL spelt out."""
    return df.select(F.concat_ws("|", *(_printed(f.name, f.dataType) for f in df.schema.fields)).alias("line"))
