"""Runs registered queries by name: ``python -m joinlab.runner NAME... [--sf DIR] [--expect DIR] [--save DIR] [--times FILE]``.

Without names all queries run. ``--save`` stores each result as Parquet under its name; ``--expect`` compares each with
the stored result of that name, as bags. ``--times`` appends a line ``name,seconds,rows,verdict`` for each query. The
exit code is the number of queries that failed or differ, 100 at most."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from joinlab.operators.compare import bag_difference
from joinlab.queries import QUERIES


def run(spark: SparkSession, names: list[str], sf_dir: str, expect: str | None = None, save: str | None = None) -> list[tuple[str, float, int, str]]:
    """(name, seconds, rows, verdict) of each query; the verdict is "ok", "run" if nothing was compared, or what is wrong."""
    if unknown := [n for n in names if n not in QUERIES]:
        raise SystemExit(f"unknown queries: {', '.join(unknown)}")
    out = []
    for name in names or sorted(QUERIES):
        began, rows, verdict = time.perf_counter(), -1, "run"
        try:
            df = QUERIES[name](spark, sf_dir)
            rows = df.count()
            took = time.perf_counter() - began
            if save:
                df.write.mode("overwrite").parquet(f"{save}/{name}")
            if expect:
                verdict = "; ".join(bag_difference(df, spark.read.parquet(f"{expect}/{name}"))) or "ok"
        except Exception as error:  # a failing query must not end the others
            took, verdict = time.perf_counter() - began, f"{type(error).__name__}: {str(error).splitlines()[0][:200]}"
        out.append((name, round(took, 3), rows, verdict))
    return out


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="joinlab.runner", description=__doc__)
    parser.add_argument("names", nargs="*")
    for option, value in (("--sf", "/root/testdata/sf0.01"), ("--expect", None), ("--save", None), ("--times", None)):
        parser.add_argument(option, default=value)
    chosen = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    found = run(spark, chosen.names, chosen.sf, chosen.expect, chosen.save)
    lines = [",".join(map(str, x)) for x in found]
    print("\n".join(lines))
    if chosen.times:
        with open(chosen.times, "a") as file:
            file.writelines(f"{x}\n" for x in lines)
    return min(100, sum(x[3] not in ("ok", "run") for x in found))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
