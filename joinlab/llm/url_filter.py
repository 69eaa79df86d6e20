"""URL filters: host-suffix and path-prefix expressions joined on short digest prefixes.

Every URL is expanded into the expressions a rule could have written for it (each host suffix, each
path prefix of a length that some rule has). Expressions meet the rules in an equi-join on the first
eight hex digits of their SHA-256; the full digest then confirms, and the longest fitting rule wins.

Defined results: a null URL, or one without ``://``, has an empty host and path and fits no rule; an
empty rule list leaves every URL with the default verdict; repeated pages give repeated rows; other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlab.llm.common import ascii_lower, table

#: Fixed values of the query: action, host, path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
PREFIX = 8


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host and path as columns, both empty where there is no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_table(spark: SparkSession, rules) -> DataFrame:
    rows = [(a, h, p, h + p) for a, h, p in rules]
    df = spark.createDataFrame(rows, "verdict string, r_host string, r_path string, rule string")
    digest = F.sha2(F.concat_ws("\n", "r_host", "r_path"), 256)
    return df.select("verdict", "rule", digest.alias("r_digest"), F.substring(digest, 1, PREFIX).alias("r_key"))


def filter_urls(pages: DataFrame, rules=RULES, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: key, host, path, rule, verdict."""
    spark = pages.sparkSession
    cut = pages.select(F.col(key).alias(key), F.coalesce(F.col(url), F.lit("")).alias("__url"))
    host, path = split_url(F.col("__url"))
    cut = cut.select(key, host.alias("host"), path.alias("path"))
    if not rules:
        return cut.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    # Only depths and lengths that occur in the rules can fit one; the rule list fixes both small sets.
    depths = F.array(*[F.lit(n) for n in sorted({h.count(".") + 1 for _, h, _ in rules})])
    lengths = F.array(*[F.lit(n) for n in sorted({len(p) for _, _, p in rules})])
    suffixes = F.transform(
        F.filter(depths, lambda n: n <= F.size(F.split("host", r"\."))),
        lambda n: F.array_join(F.slice(F.split("host", r"\."), -n, n), "."),
    )
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    digests = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.sha2(F.concat_ws("\n", h, p), 256))))
    # Distinct addresses are judged once, whatever number of pages shares one.
    distinct = cut.select("host", "path").distinct().withColumn("digest", F.explode_outer(digests)).withColumn("r_key", F.substring("digest", 1, PREFIX))
    table_ = F.broadcast(rule_table(spark, rules)) if len(rules) <= 100_000 else rule_table(spark, rules)
    hits = distinct.join(table_, "r_key").where("digest = r_digest")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
    return cut.join(best, ["host", "path"], "left").select(
        key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages", "page_id", "url"))


ORACLE = """
WITH rules(verdict, r_host, r_path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'),
  ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (SELECT p.*, r.verdict AS v, r_host || r_path AS rule,
  row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC) AS k
  FROM parts p LEFT JOIN rules r ON (p.host = r_host OR suffix(p.host, '.' || r_host)) AND starts_with(p.path, r_path))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fits WHERE k = 1
"""
