"""Line dedup: an exact set-similarity join over lines, in DataFrame functions only.

1. Keys. A line's tokens are its distinct words, lower-cased. A token's key is its length in bytes, long ones first
   (modulo 64, so very long ones stand elsewhere), before 58 bits of its hash: one global order of all tokens that mostly puts rare
   ones first and needs no pass over the text to count them.
2. Equal sets. Lines with equal keys (two 64-bit hashes over them) collapse to the first place, by id and line number.
3. Prefix. Sets of n and m tokens with ``o`` in common differ in ``d = n + m - 2 o`` tokens. Each of those lies in one
   gap between common tokens, so among the first ``d + 2`` common ones two neighbours have nothing between them and
   stand side by side in both sets; in the set of n they are among the first ``d + 2 + n - o``, at most
   ``floor(2 (1 - t) n) + 2``. So each set gives the twos of neighbours in a prefix of that length (20 bits of each of
   the two keys); sets that share one are candidates if they pass the length filter, the positional filter and a bitmap
   filter (one bit a token, flipped: two sets differ in at least as many tokens as their bitmaps in bits). Twos of rare
   words seldom meet by chance, so groups stay small: those of one set alone are dropped after one sort. Sets of up to
   three tokens have no similar sets but equal ones and stay out. The twos are taken in ``SHARES`` shares, so that their
   shuffle takes less disk.
4. Leaders. The sets of a two are each first compared with the earliest of them alone, without a join. One earlier
   similar line is enough to remove a line, so those that are similar to it are settled; the others then meet all other
   sets of their groups of three or more. A large group of near copies costs as many comparisons as it has members. A
   pair comes out of the join at the first two that it shares: a row knows the three tokens before its two, and a
   pair with the same neighbours among them has come before, as those are keys of the join too. One token confused by
   its 20 bits only adds candidates (the positional bound still holds); a pair is lost only if both tokens of a two
   collide, 40 bits, at most three places before the first shared two.
5. Verification. The candidate lines are read again from the text at their places and their words compared.

A line is removed if an earlier line (by id, then line number) has similarity ``t`` or more, judged on the input, so
the result does not depend on any order of work. Texts move twice at most: to verify candidates and to be cut.

Defined results: null texts are empty; lines without words are never removed; rows with one id are one place, so
repeated rows do not remove each other and share their removed line numbers; rows with a null id are such a place too,
the first of all; equal lines are ties that the earliest place wins; a very long text or line is one row of words and is
cut whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from joinlab.llm.common import drop_stored, settings, store, table, whole_text

SIMILARITY = 0.8
#: Bytes of a word whose key is 0 above its hash (longer ones have keys below 0; from 64 bytes on the lengths come round,
#: which is an order as well), and bits of a key below the length.
LONGEST, LENGTH_AT = 31, 58
#: Bits of each of two neighbours.
TOKEN_BITS = 20
#: Tokens above which a bitmap has 128 bits instead of 64.
WIDE = 24
#: Sets that share a two from which they are first compared with the earliest of them alone.
COMMON = 2
#: Parts of the twos that are joined one after another.
SHARES = 3
#: Size of a partition up to which a join hashes it instead of sorting both sides.
HASHED = "32m"
#: Joins of a text or an index with a list never broadcast the list, so small and large tables have one plan.
SHUFFLED = {"spark__sql__autoBroadcastJoinThreshold": "-1", "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1"}


def _plain(low: F.Column) -> F.Column:
    """Every white space but the line feed as a space."""
    other = functools.reduce(operator.or_, (F.contains(low, F.lit(x)) for x in "\t\x0b\f\r"))
    return F.when(other, F.regexp_replace(low, r"[\t\x0B\f\r]", " ")).otherwise(low)


def _words(line: F.Column) -> F.Column:
    return F.array_remove(F.split(line, " "), "")


def _key(word: F.Column) -> F.Column:
    length = F.shiftleft((LONGEST - F.octet_length(word)).cast("long"), LENGTH_AT)
    return length.bitwiseOR(F.shiftrightunsigned(F.xxhash64(word), 64 - LENGTH_AT))


def cut_lines(rows: DataFrame, similarity: float) -> DataFrame:
    """A row for each line with words: id, line, s1 and s2 (hashes of its set), n, bits and more (its bitmap; more is 0
    up to ``WIDE`` tokens), prefix (the keys whose neighbours are its twos)."""
    # A step of its own, since Spark would lower-case the text for each use of it.
    plain = rows.select("id", F.lower("t").alias("low")).select("id", _plain(F.col("low")).alias("plain"))
    lines = plain.select("id", F.posexplode(F.split("plain", "\n")).alias("line", "body")).where("trim(body) != ''")
    keys = F.array_except(F.transform(F.split("body", " "), _key), F.array(_key(F.lit(""))))  # different ones only
    keyed = lines.select("id", "line", F.sort_array(keys).alias("keys"))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63)).cast("int"))
    none, n = F.lit(0).cast("long"), F.size("keys")
    every = F.aggregate("keys", none, lambda bits, k: bits.bitwiseXOR(bit(k)))
    more = F.when(n > WIDE, F.aggregate("keys", none, lambda bits, k: F.when(k.bitwiseAND(F.lit(64)) == 0, bits).otherwise(bits.bitwiseXOR(bit(k))))).otherwise(none)
    count = F.when(n > 3, F.least(F.floor(n * (2 - 2 * similarity) + 1e-9).cast("int") + 2, n)).otherwise(0)
    cut = keyed.select("id", "line", F.xxhash64("keys").alias("s1"), F.xxhash64(F.lit(1), "keys").alias("s2"), n.alias("n"), every.alias("every"), more.alias("more"), F.slice("keys", F.lit(1), count).alias("prefix"))
    return cut.select("id", "line", "s1", "s2", "n", F.col("every").bitwiseXOR(F.col("more")).alias("bits"), "more", "prefix")


def _apart() -> F.Column:
    """Tokens in which two sets differ at least. One of up to ``WIDE`` tokens has 64 bits, so the other's 128 are folded."""
    bits_e, more_e, bits_l, more_l = (F.col(f"{c}_{x}") for x in "el" for c in ("bits", "more"))
    both = F.bit_count(bits_e.bitwiseXOR(bits_l)) + F.bit_count(more_e.bitwiseXOR(more_l))
    folded = F.bit_count(bits_e.bitwiseXOR(more_e).bitwiseXOR(bits_l).bitwiseXOR(more_l))
    return F.when((F.col("n_e") > WIDE) & (F.col("n_l") > WIDE), both).otherwise(folded)


def _pass(similarity: float) -> F.Column:
    """The filters on an earlier set (columns ending in _e) and a later one (_l) that share the twos at their places at_e
    and at_l. If those are the first twos that they share, each gap between common tokens before has a token of one of
    them alone, so at most a third of the tokens before are common."""
    n_e, n_l, at_e, at_l = (F.col(f"{c}_{x}") for c in ("n", "at") for x in "el")
    share = F.ceil((n_e + n_l) * (similarity / (1 + similarity)) - 1e-9)
    length = (n_e >= n_l * similarity - 1e-9) & (n_l >= n_e * similarity - 1e-9)
    fits = length & (_apart() <= n_e + n_l - 2 * share) & (F.struct("id_e", "line_e") < F.struct("id_l", "line_l"))
    return (F.floor((at_e + at_l) / 3) + F.least(n_e - at_e, n_l - at_l) >= share) & fits


#: A set at one of its twos: its place, its number of tokens and (in the lower 32 bits) the place of the two, its bitmap,
#: the three tokens before the two.
PLACE = ("id", "line", "sizes", "bits", "more", "before")
PAIR = ("id_e", "line_e", "id_l", "line_l", "apart")


def _unpacked(pairs: DataFrame) -> DataFrame:
    for x in "el":
        sizes = F.col(f"sizes_{x}")
        pairs = pairs.withColumns({f"n_{x}": F.shiftrightunsigned(sizes, 32), f"at_{x}": sizes.bitwiseAND(F.lit((1 << 32) - 1))})
    return pairs


def _follows() -> F.Column:
    """Two neighbours up to three places before are shared as well, so these are not the first, and all filters let the
    first ones pass that let these."""
    at_e, at_l, before_e, before_l = (F.col(f"{c}_{x}") for c in ("at", "before") for x in "el")
    part = lambda tokens, low, many: F.shiftrightunsigned(tokens, low * TOKEN_BITS).bitwiseAND(F.lit((1 << many * TOKEN_BITS) - 1))
    found = (at_e > 0) & (at_l > 0) & (part(before_e, 0, 1) == part(before_l, 0, 1))
    for e, l in ((0, 1), (1, 0), (1, 1)):  # noqa: E741
        found |= (at_e > e + 1) & (at_l > l + 1) & (part(before_e, e, 2) == part(before_l, l, 2))
    return found


def _side(index: DataFrame, end: str) -> DataFrame:
    return index.select("sig", *(F.col(c).alias(f"{c}_{end}") for c in index.columns if c != "sig")).hint("merge")


def _closest(pairs: DataFrame) -> DataFrame:
    """For each later set its closest earlier one, by bitmap."""
    return pairs.groupBy("id_l", "line_l").agg(F.min(F.struct("apart", "id_e", "line_e")).alias("x")).select("id_l", "line_l", "x.*")


def shared_twos(sets: DataFrame, similarity: float, common: int) -> list[DataFrame]:
    """For each share of the twos a stored table of those that several sets have: sig, PLACE, first (this row is the
    earliest of its group and met all others), rest (it is in a group of more than two, or of two that did not meet), id_e,
    line_e, apart (the earliest of the group if it is a candidate for this row)."""
    keys = F.slice("prefix", F.lit(1), F.greatest(F.size("prefix") - 1, F.lit(0)))
    twos = sets.select("prefix", F.posexplode(keys).alias("at", "key"), "id", "line", "n", "bits", "more")
    token = lambda k: F.coalesce(F.get("prefix", F.col("at") + k), F.lit(0).cast("long")).bitwiseAND(F.lit((1 << TOKEN_BITS) - 1))
    packed = lambda *ks: functools.reduce(lambda x, k: F.shiftleft(x, TOKEN_BITS).bitwiseOR(token(k)), ks[1:], token(ks[0]))
    sizes = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("at").cast("long"))
    twos, found = twos.select(packed(0, 1).alias("sig"), "id", "line", sizes.alias("sizes"), "bits", "more", packed(-3, -2, -1).alias("before")), []
    group, led = W.partitionBy("sig"), F.col("size") >= common
    for k in range(SHARES):
        # Most twos are of one set alone: they are only counted and gone before the second window, which needs no other sort.
        part = twos.where(F.col("sig") % SHARES == k).withColumn("size", F.count("*").over(group)).where("size > 1")
        part = part.withColumn("x", F.min(F.struct(*PLACE)).over(group))
        part = _unpacked(part.select("sig", "size", *(F.col(c).alias(f"{c}_l") for c in PLACE), *(F.col(f"x.{c}").alias(f"{c}_e") for c in PLACE)))
        first = F.struct(*(f"{c}_e" for c in PLACE)).eqNullSafe(F.struct(*(f"{c}_l" for c in PLACE)))
        part = part.withColumn("apart", F.when(led & _pass(similarity), _apart())).withColumn("rest", ~led | (F.col("size") > 2)).withColumn("first", led & first)
        found.append(store(part.where("rest OR apart IS NOT NULL").select("sig", *(F.col(f"{c}_l").alias(c) for c in PLACE), "first", "rest", "id_e", "line_e", "apart"), "shared"))
    return found


def leader_pairs(shared: list[DataFrame]) -> DataFrame:
    """The pairs of a set with the earliest one of a group, each once."""
    pairs = functools.reduce(DataFrame.unionByName, (df.where("apart IS NOT NULL").select("id_e", "line_e", F.col("id").alias("id_l"), F.col("line").alias("line_l"), "apart") for df in shared))
    return store(pairs.distinct(), "pairs")


def candidate_pairs(shared: list[DataFrame], settled: DataFrame, similarity: float) -> list[DataFrame]:
    """Pairs of a set that is not settled with an earlier one, other than the earliest of a group, that pass all filters."""
    done = settled.select(F.col("id").alias("d_id"), F.col("line").alias("d_line"), F.lit(False).alias("open"))
    found = []
    with settings(settled.sparkSession, **SHUFFLED):
        for df in shared:
            rest = df.where("rest AND NOT first").select("sig", *PLACE)
            rest = rest.join(done, F.col("id").eqNullSafe(F.col("d_id")) & (F.col("line") == F.col("d_line")), "left")
            rest = rest.select("sig", *PLACE, F.when(F.col("open").isNull(), 1).otherwise(0).alias("open"))
            # One shuffle serves both sides as long as both are the same: none is filtered, both give all their columns.
            pairs = _unpacked(_side(rest, "e").join(_side(rest, "l"), "sig").where(2 * F.col("open_l") + F.col("open_e") > 1))
            pairs = pairs.where(_pass(similarity) & ~_follows()).withColumn("apart", _apart())
            found.append(store(pairs.select(*PAIR).distinct(), "part"))
    return found


def words_at(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """id, line, words: the different words of each place in pairs, read from the text, stored."""
    ends = pairs.select(F.explode(F.array(*(F.struct(F.col(f"id_{x}").alias("id"), F.col(f"line_{x}").alias("line")) for x in "el"))).alias("p"))
    wanted = store(ends.groupBy(F.col("p.id").alias("at_id")).agg(F.collect_set("p.line").alias("wanted")), "wanted")
    # Few texts are wanted, so a runtime Bloom filter of their ids (Spark bounds its size) drops most before they move; the
    # condition, which holds for all, tells Spark that the list is worth a filter.
    wanted_rows = wanted.where("size(wanted) > 0")
    # A document is one row on the side of the lines, so that side hashes well; beyond the threshold Spark sorts.
    texts = rows.join(wanted_rows, F.col("id").eqNullSafe(F.col("at_id"))).select("id", "wanted", F.lower("t").alias("low"))
    texts = texts.select("id", "wanted", F.split(_plain(F.col("low")), "\n").alias("lines"))
    # A repeated id may have texts of fewer lines. The second use of the lines keeps Spark from cutting the text once for
    # each wanted line.
    there = F.filter("wanted", lambda i: i < F.size("lines"))
    lines = texts.select("id", F.explode(F.transform(there, lambda i: F.struct(i.alias("line"), F.get("lines", i).alias("body")))).alias("x"))
    with settings(rows.sparkSession, **SHUFFLED, spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold="0"):
        words = store(lines.select("id", "x.line", F.array_distinct(_words(F.col("x.body"))).alias("words")), "words")
    drop_stored(wanted)
    return words


def verified(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """id, line: the places that are the later end of a pair whose words have enough similarity, stored."""
    for x in "el":
        end = words.select(F.col("id").alias("w_id"), F.col("line").alias("w_line"), F.col("words").alias(f"words_{x}"))
        pairs = pairs.join(end, F.col(f"id_{x}").eqNullSafe(F.col("w_id")) & (F.col(f"line_{x}") == F.col("w_line"))).drop("w_id", "w_line")
    shared, both = F.size(F.array_intersect("words_e", "words_l")), F.size("words_e") + F.size("words_l")
    near = pairs.where(shared * (1 + similarity) >= both * similarity - 1e-9)
    with settings(words.sparkSession, **SHUFFLED):
        return store(near.select(F.col("id_l").alias("id"), F.col("line_l").alias("line")).distinct(), "near")


def nearest(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """id, line: the later sets that are similar to the closest of their candidates, by bitmap."""
    closest = store(_closest(pairs), "closest")
    words = words_at(closest, rows)
    settled = verified(closest, words, similarity)
    drop_stored(closest, words)
    return settled


def others(pairs: DataFrame, settled: DataFrame, rows: DataFrame, similarity: float) -> list[DataFrame]:
    """id, line: the later sets that are not settled and similar to any of their candidates. One earlier line is enough,
    so each is compared with its closest candidate first, and those that it does not settle with all others."""
    done = lambda df: df.select(F.col("id").alias("d_id"), F.col("line").alias("d_line"))
    same = F.col("id_l").eqNullSafe(F.col("d_id")) & (F.col("line_l") == F.col("d_line"))
    with settings(rows.sparkSession, **SHUFFLED):
        left = store(pairs.join(done(settled), same, "left_anti").distinct(), "left")
    words = words_at(left, rows)
    closest = verified(_closest(left), words, similarity)
    with settings(rows.sparkSession, **SHUFFLED):
        last = store(left.join(done(closest), same, "left_anti"), "left")
    rest = verified(last, words, similarity)
    drop_stored(left, words, last)
    return [closest, rest]


def union(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables)


def similar_lines(rows: DataFrame, similarity: float = SIMILARITY, common: int = COMMON) -> DataFrame:
    """rows: id, t. Returns the places (id, line) whose line has a similar earlier one, stored."""
    if not 0.75 < similarity <= 1:
        raise ValueError("similarity must be over 0.75 and at most 1")
    cut = store(cut_lines(rows, similarity), "cut")
    order = F.row_number().over(W.partitionBy("s1", "s2").orderBy("id", "line"))
    sets = store(cut.withColumn("order", order).where("order = 1").drop("order"), "sets")
    first = sets.select("s1", "s2", F.struct("id", "line").alias("place"))
    with settings(rows.sparkSession, **SHUFFLED):
        equal = store(cut.join(first, ["s1", "s2"]).where(F.col("place") < F.struct("id", "line")).select("id", "line"), "equal")
    drop_stored(cut)
    shared = shared_twos(sets, similarity, common)
    drop_stored(sets)
    led = leader_pairs(shared)
    settled = nearest(led, rows, similarity)
    found = candidate_pairs(shared, settled, similarity)
    drop_stored(*shared)
    near = others(union([led, *found]), settled, rows, similarity)
    out = store(union([equal, settled, *near]).distinct(), "similar")
    drop_stored(led, *found, equal, settled, *near)
    return out


def remove_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, common: int = COMMON) -> DataFrame:
    """One row per input row: key, n_lines, n_removed, kept (the lines that stay), kept_sha256."""
    rows = docs.select(F.col(key).alias("id"), whole_text(text).alias("t"))
    similar = similar_lines(rows, similarity, common)
    gone = store(similar.groupBy(F.col("id").alias("gone_id")).agg(F.collect_set("line").alias("gone")), "gone")
    drop_stored(similar)
    out = rows.join(gone.hint("merge"), F.col("id").eqNullSafe(F.col("gone_id")), "left").withColumn("parts", F.split("t", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "gone")
    out = out.withColumn("stay", F.when(F.col("gone").isNotNull(), stay))
    kept = F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.array_join(F.transform("stay", lambda i: F.get("parts", i)), "\n"))
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("parts") - F.size("stay")).cast("long")
    out = out.select("id", F.size("parts").cast("long").alias("n_lines"), n_removed.alias("n_removed"), kept.alias("kept"))
    return out.withColumn("kept_sha256", F.sha2("kept", 256)).withColumnRenamed("id", key)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_lines(table(spark, sf_dir, "documents", "doc_id", "text")).drop("kept")
