"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in SQL only.

A source's documents are permuted by a digest of their id and cut into blocks by the digest's first hex
digits, so every block is a random share of its source. Targets turn into whole passes over a source and
a last part of a pass; each block of a pass is one unit. A binary tree over the output shards splits the
units: at every node the left half's units are drawn without replacement, source after source, which
gives multivariate-hypergeometric counts with exact totals. Leaf counts then claim disjoint runs of the
permuted units, and rows of a shard are shuffled locally by a digest.

Only blocks are counted and ranked (at most BLOCKS rows a source), and a row-level running sum runs inside
one block of one source, so a source with a third of all rows is spread over all blocks.

Defined results: null texts have size 0; a null source is a source of its own, last in order; null ids
share one place in the permutation (ties go by size); repeated rows are taken each; an empty table gives an empty mix;
if no document has a word, all targets are 0; very long texts are counted whole and one may end its source's target
alone; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from joinlab.llm.common import WORD, store, table

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
#: Hex digits of a block's name, 4,096 blocks a source; rows from which it has one more; the most digits.
BLOCK_DIGITS, ROWS_A_DIGIT, MOST_DIGITS = 3, 1 << 28, 4
SHARDS = 16


def block_digits(rows: int) -> int:
    return min(MOST_DIGITS, BLOCK_DIGITS + (rows > ROWS_A_DIGIT))


def sized(docs: DataFrame, key: str, text: str, source: str, keep: tuple[str, ...] = (), digits: int = BLOCK_DIGITS) -> DataFrame:
    order = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":mix")))
    return docs.select(
        F.col(key).alias("id"),
        F.col(source).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")).alias("src"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        order.alias("place"),
        F.substring(order, 1, digits).alias("block"),
        *(F.col(c).alias(f"keep_{c}") for c in keep),
    )


def source_targets(blocks: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """src, source_size, target: weighted shares, cut at ``most`` times the size, the excess reshared.

    Sources that reach their cap are those with the smallest cap a weight; with them set aside, one level
    holds for all the others."""
    sizes = blocks.groupBy("src").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    order = W.orderBy(F.col("cap").cast("double") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    every = W.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(every) - before) / after
    ranked = ranked.withColumn("level", level)
    first = F.min_by(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")), F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("cap").cast("double") / F.col("weight"))).over(every)
    target = F.least(F.col("cap").cast("double"), F.coalesce(first * F.col("weight"), F.col("cap").cast("double")))
    return ranked.select("src", "source_size", target.alias("target"))


def split_units(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """counts: src, n. Returns src, shard, n; the sum over shards is n, and shards get equal numbers of units
    (to one). Each level halves every node by draws without replacement."""
    nodes = counts.where("n > 0").agg(F.sort_array(F.collect_list(F.struct("src", "n"))).alias("items")).select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "items")
    width = shards
    while width > 1:
        draw = f"""
            aggregate(items,
              named_struct('rest', aggregate(items, 0L, (a, x) -> a + x.n),
                           'room', aggregate(items, 0L, (a, x) -> a + x.n) * cast((hi - lo) div 2 AS bigint) div greatest(hi - lo, 1),
                           'made', cast(array() AS array<struct<src: string, l: bigint, r: bigint>>)),
              (acc, x) -> aggregate(sequence(1L, x.n), named_struct('rest', acc.rest, 'room', acc.room, 'l', 0L),
                (s, i) -> if((xxhash64({seed}L, lo, hi, x.src, i) & 2147483647) / 2147483648D * s.rest < s.room,
                             named_struct('rest', s.rest - 1, 'room', s.room - 1, 'l', s.l + 1),
                             named_struct('rest', s.rest - 1, 'room', s.room, 'l', s.l)),
                s -> named_struct('rest', s.rest, 'room', s.room,
                                  'made', concat(acc.made, array(named_struct('src', x.src, 'l', s.l, 'r', x.n - s.l)))))
            ).made"""
        halves = """explode(if(hi - lo > 1, array(
              named_struct('lo', lo, 'hi', lo + (hi - lo) div 2, 'items', transform(filter(made, x -> x.l > 0), x -> named_struct('src', x.src, 'n', x.l))),
              named_struct('lo', lo + (hi - lo) div 2, 'hi', hi, 'items', transform(filter(made, x -> x.r > 0), x -> named_struct('src', x.src, 'n', x.r)))),
              array(named_struct('lo', lo, 'hi', hi, 'items', items)))) AS half"""
        nodes = nodes.withColumn("made", F.expr(draw)).selectExpr("lo", "hi", "items", halves).selectExpr("cast(half.lo AS int) AS lo", "cast(half.hi AS int) AS hi", "half.items AS items")
        width = (width + 1) // 2
    return nodes.select(F.col("lo").alias("shard"), F.explode("items").alias("x")).select("x.src", "shard", "x.n")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", shards: int = SHARDS, seed: int = 0, keep: tuple[str, ...] = (), **shares) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken, takes, and the columns named in ``keep``.

    ``takes`` lists (pass, shard, words, place) of the row's copies in the mix; words are fewer than the size only
    for the one document where a source's target ends; ``place`` orders a shard's rows at random."""
    rows = store(sized(docs, key, text, source, keep, block_digits(docs.count())), "sized")
    blocks = rows.groupBy("src", "block").agg(F.first("source").alias("source"), F.sum("size").alias("words"), F.count("*").alias("n"))
    blocks = store(blocks, "blocks")
    targets = source_targets(blocks, **shares)
    quota = F.round("target").cast("long")
    targets = targets.withColumns({"whole": F.coalesce(F.try_divide(quota - F.pmod(quota, F.col("source_size")), "source_size"), F.lit(0)).cast("int"), "part": F.coalesce(F.expr("try_mod(cast(round(target) AS bigint), source_size)"), F.lit(0).cast("long"))})
    targets = store(targets, "targets")
    run = W.partitionBy("src").orderBy("block")
    placed = blocks.join(targets, "src").withColumn("before", F.sum("words").over(run.rowsBetween(W.unboundedPreceding, 0)) - F.col("words"))
    # A unit: a block in one pass, with the words it may give (null: all of them).
    units = placed.select(
        "src", "block",
        F.explode(F.expr("""concat(
            if(whole > 0, transform(sequence(1, whole), p -> named_struct('pass', p, 'room', cast(null AS bigint))), cast(array() AS array<struct<pass: int, room: bigint>>)),
            if(before < part, array(named_struct('pass', whole + 1, 'room', part - before)), cast(array() AS array<struct<pass: int, room: bigint>>)))""")).alias("u"),
    ).select("src", "block", "u.pass", "u.room")
    place = W.partitionBy("src").orderBy("pass", F.md5(F.concat_ws(":", F.lit(seed), "pass", "block")), "block")
    units = store(units.withColumn("at", F.row_number().over(place)), "units")
    leaves = split_units(units.groupBy("src").agg(F.count("*").alias("n")), shards, seed)
    end = F.sum("n").over(W.partitionBy("src").orderBy("shard").rowsBetween(W.unboundedPreceding, 0))
    claims = leaves.withColumn("end", end).withColumn("at", F.explode(F.expr("sequence(end - n + 1, end)"))).select("src", F.col("at").cast("int").alias("at"), "shard")
    dealt = units.join(claims, ["src", "at"]).groupBy("src", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard", "room"))).alias("units"))
    inside = W.partitionBy("src", "block").orderBy("place", "size", "id").rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("before", F.sum("size").over(inside) - F.col("size")).join(dealt, ["src", "block"], "left").join(targets, "src")
    takes = F.expr("""filter(transform(coalesce(units, array()), u -> named_struct('pass', u.pass, 'shard', u.shard,
        'words', if(u.room IS NULL, size, greatest(0L, least(size, u.room - before))), 'place', xxhash64(place, u.pass))), t -> t.words > 0)""")
    return out.withColumn("takes", takes).select(
        F.col("id").alias(key), F.col("source").alias(source), "size", "source_size", "target",
        F.expr("aggregate(takes, 0L, (a, t) -> a + t.words)").alias("taken"), "takes",
        *(F.col(f"keep_{c}").alias(c) for c in keep),
    )


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
  md5(coalesce(doc_id::VARCHAR, '') || ':mix') AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 2 AS cap,
  row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
   - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
   / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM r),
f AS (SELECT *, min_by(level, cap::DOUBLE / weight) FILTER (level * weight <= cap) OVER () AS chosen FROM l),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(chosen * weight, cap::DOUBLE)) AS target FROM f),
c AS (SELECT d.*, t.source_size, t.target, round(t.target)::BIGINT AS quota,
  sum(size) OVER (PARTITION BY d.source ORDER BY place, size, doc_id ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (CASE WHEN source_size = 0 THEN 0 ELSE (quota // source_size) * size
  + greatest(0, least(size, quota % source_size - before)) END)::BIGINT AS taken FROM c
"""
