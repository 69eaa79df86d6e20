"""Random select-project-join queries, through the SQL subset and through the plan import, against DuckDB."""

import random

import duckdb
import pytest

from joinlab import runner
from joinlab.functions.predicates import Comparison, Options, one_of
from joinlab.plans.explain_import import import_plan
from joinlab.plans.sql_subset import parse, run_sql
from joinlab.sources import files
from joinlab.sources.catalog import Catalog, parquet_table

COLUMNS = ("id", "v", "w")


@pytest.fixture(scope="module")
def tables(spark):
    rng, con, out = random.Random(1), duckdb.connect(), {}
    for name in ("t", "u", "x"):
        rows = [tuple(rng.choice((None, 1, 2, 3, 4)) for _ in COLUMNS) for _ in range(14)]
        out[name] = spark.createDataFrame(rows, "id int, v int, w int")
        con.execute(f"CREATE TABLE {name} (id INT, v INT, w INT)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?, ?)", rows)
    return out, con


def made(rng):
    """A query's text and its aliases in an order in which each joins one before it."""
    aliases = [(rng.choice("tux"), f"a{k}") for k in range(rng.randint(2, 4))]
    equal = [f"{a}.{rng.choice(COLUMNS)} = {rng.choice(aliases[:k])[1]}.{rng.choice(COLUMNS)}" for k, (_, a) in enumerate(aliases) if k]
    for _ in range(rng.randint(0, 2)):
        (_, a), (_, b) = rng.sample(aliases, 2)
        equal.append(f"{a}.{rng.choice(COLUMNS)} = {b}.{rng.choice(COLUMNS)}")
    only = [f"{rng.choice(aliases)[1]}.{rng.choice(COLUMNS)} {rng.choice(('= 2', '> 1', '<= 3', '!= 1', 'IS NOT NULL', 'BETWEEN 1 AND 3', 'IN (1, 3)'))}" for _ in range(rng.randint(0, 2))]
    picked = [f"{a}.{rng.choice(COLUMNS)} AS o{k}" for k, (_, a) in enumerate(aliases)]
    return f"SELECT {', '.join(picked)} FROM {', '.join(f'{t} AS {a}' for t, a in aliases)} WHERE {' AND '.join(equal + only)}", aliases


@pytest.mark.parametrize("seed", range(25))
def test_random_queries(spark, tables, seed):
    frames, con = tables
    text, aliases = made(random.Random(seed))
    query = parse(text, {t: list(COLUMNS) for t in frames})
    tree = None
    for t, a in aliases:
        leaf = {"Node Type": "Seq Scan", "Relation Name": t, "Alias": a}
        tree = leaf if tree is None else {"Node Type": "Hash Join", "Plans": [leaf, {"Node Type": "Hash", "Plans": [tree]}]}
    want = sorted(map(repr, con.execute(text).fetchall()))
    assert sorted(repr(tuple(r)) for r in import_plan(tree, query, frames).collect()) == want, text
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    assert sorted(repr(tuple(r)) for r in run_sql(spark, text, "agg").collect()) == want, text


def test_unclosed_quotes(spark, tmp_path):
    schema = spark.createDataFrame([], "a int, b string").schema
    for k, (text, good) in enumerate((('1,"x\n2,y\n', False), ('1,x\n2,"y\\"\n', False), ('1,"x\\"y"\n', True), ('1,"x\ny"\n', True))):
        path = tmp_path / f"{k}.csv"
        path.write_text(text)
        if good:
            assert files.read_csv(spark, schema, str(path)).count() == 1
        else:
            with pytest.raises(ValueError, match="not closed"):
                files.read_csv(spark, schema, str(path))
            with pytest.raises(ValueError, match="not closed"):
                files.read_csv(spark, schema, str(path), multi_line=False)
    assert files.read_csv(spark, schema, str(tmp_path / "0.csv"), check_quotes=False).count() == 1


def test_long_in_and_escapes(spark):
    df = spark.range(5000)
    assert df.where(one_of("id", *range(0, 9000, 2)).to_column()).count() == 2500
    signs = spark.createDataFrame([("~^`|!\\",), ("b",)], "s string")
    assert signs.where(Comparison("s", "like", "~^`|!\\%").to_column()).count() == 1
    strict = Options(strict_types=True)
    assert signs.where(Comparison("s", "neq", 5).to_column(options=strict)).count() == 0
    assert df.where(one_of("id", 3, "4").to_column(options=strict)).count() == 1


def test_tables_are_loaded_once(spark, tmp_path):
    path, reads = str(tmp_path / "t.parquet"), []
    spark.range(10).write.parquet(path)
    catalog = Catalog(spark)
    read = lambda: reads.append(1) or spark.read.parquet(path)
    few = Comparison("id", "lt", 3)
    assert catalog.load("t", read).count() == 10 and catalog.load("t", read, few).count() == 3 and catalog.load("t", read, few).count() == 3 and len(reads) == 1
    catalog.forget("t")
    assert catalog.load("t", read).count() == 10 and len(reads) == 2
    catalog.forget("t")
    assert parquet_table(spark, path).columns == ["id"]
    spark.range(3).selectExpr("id", "id AS other").write.mode("overwrite").parquet(path)
    assert parquet_table(spark, path).columns == ["id", "other"]


def test_runner(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    names = ["filter_eq_int", "join_inner"]
    assert [x[3] for x in runner.run(spark, names, folder, save=str(tmp_path))] == ["run", "run"]
    assert [x[3] for x in runner.run(spark, names, folder, expect=str(tmp_path))] == ["ok", "ok"]
    (found,) = runner.run(spark, ["filter_neq"], folder, expect=str(tmp_path))
    assert found[3] not in ("ok", "run")
    with pytest.raises(SystemExit):
        runner.run(spark, ["nothing"], folder)
