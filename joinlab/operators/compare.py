"""Order-insensitive comparison of two results as bags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bag_difference(a: DataFrame, b: DataFrame) -> list[str]:
    """What differs: column count, types, or rows; an empty list if nothing does. Names do not count."""
    if len(a.columns) != len(b.columns):
        return [f"{len(a.columns)} columns and {len(b.columns)}"]
    kinds = [(x.dataType.simpleString(), y.dataType.simpleString()) for x, y in zip(a.schema, b.schema, strict=True)]
    if wrong := [f"column {i}: {x} and {y}" for i, (x, y) in enumerate(kinds) if x != y]:
        return wrong
    names = [f"c{i}" for i in range(len(kinds))]
    both = a.toDF(*names).withColumn("side", F.lit(1)).unionAll(b.toDF(*names).withColumn("side", F.lit(-1)))
    # One aggregation finds the multiplicities that differ; only their number reaches the driver.
    off = both.groupBy(*names).agg(F.sum("side").alias("n")).where("n <> 0").agg(F.count("*"), F.sum(F.abs("n"))).first()
    return [f"{off[0]} distinct rows differ, {off[1]} counting repeats"] if off[0] else []
