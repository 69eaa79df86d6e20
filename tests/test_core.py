"""Plans, predicates, the SQL subset, plan import, files and comparison."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joinlab import queries
from joinlab.functions.predicates import Comparison, Not, Options, between, like_regex, one_of
from joinlab.operators.compare import bag_difference
from joinlab.plans.explain_import import PlanError, import_plan
from joinlab.plans.plan import Plan
from joinlab.plans.sql_subset import SqlError, parse, run_sql, strip_functions
from joinlab.sources import files
from joinlab.sources.catalog import Catalog, movie_schemas

SF = "/root/testdata/sf0.001"


def frame(spark, rows, kinds="k int"):
    return spark.createDataFrame(rows, kinds)


def joined(spark, left, right, kinds="k int", build_left=True, lk=0, rk=0, outputs=(0, 1), scans=((0,), (0,))):
    plan = Plan()
    nodes = [plan.scan(plan.add_input(frame(spark, rows, kinds)), cols) for rows, cols in zip((left, right), scans)]
    plan.join(build_left, *nodes, lk, rk, outputs)
    return sorted(map(tuple, plan.execute(honour_build_side=True).collect()))


def ints(*values):
    return [(v,) for v in values]


WIDE = [(1, "xxx"), (1, "yyy"), (None, "zzz"), (2, "uuu"), (3, "vvv")]


def test_plan_cases(spark):
    assert joined(spark, [], []) == []
    assert joined(spark, ints(1), ints(1)) == [(1, 1)]
    assert joined(spark, ints(1, 2, 3), ints(1, 2, 3)) == [(1, 1), (2, 2), (3, 3)]
    assert joined(spark, ints(1, 2, 3), ints(4, 5, 6)) == []
    assert joined(spark, ints(1, 1, 2, 3), ints(1, 1, 2, 3)) == [(1, 1)] * 4 + [(2, 2), (3, 3)]
    assert joined(spark, ints(1, 1, None, 2, 3), ints(1, 1, None, 2, 3)) == [(1, 1)] * 4 + [(2, 2), (3, 3)]
    for build_left in (True, False):
        got = joined(spark, WIDE, WIDE, "k int, v string", build_left, 0, 1, (0, 2, 1), ((0,), (1, 0)))
        assert got == [(1, 1, "xxx")] * 2 + [(1, 1, "yyy")] * 2 + [(2, 2, "uuu"), (3, 3, "vvv")]


def test_plan_three_way_and_checks(spark):
    plan = Plan()
    tables = [[(1, "a"), (2, "b"), (3, "c")], [(1, "x"), (2, "y")], [(1, "u"), (2, "v"), (3, "w")]]
    a, b, c = (plan.scan(plan.add_input(frame(spark, t, "k int, v string")), (0, 1)) for t in tables)
    ab = plan.join(False, a, b, 0, 0, (0, 1))
    plan.join(False, ab, c, 0, 0, (0, 1, 3))
    assert sorted(map(tuple, plan.execute().collect())) == [(1, "a", "u"), (2, "b", "v")]
    plan.join(True, a, plan.scan(plan.add_input(frame(spark, [(1,)], "k bigint")), (0,)), 0, 0, (0,))
    assert plan.execute().count() == 1
    with pytest.raises(TypeError):
        plan.execute(strict_keys=True)
    plan.join(True, a, b, 0, 0, (9,))
    with pytest.raises(IndexError):
        plan.execute()


def test_predicates_with_nulls(spark):
    df = frame(spark, ints(1, 5, None))
    keep = lambda p, o=Options(): sorted((r.k for r in df.where(p.to_column(options=o)).collect()), key=str)
    assert keep(Not(Comparison("k", "eq", 5))) == [1]
    assert keep(Not(Comparison("k", "eq", 5)), Options(two_valued_not=True)) == [1, None]
    assert keep(Comparison("k", "neq", 5)) == [1] and keep(Comparison("k", "is_null")) == [None]
    assert keep(between("k", 2, 9)) == [5] and keep(one_of("k", 1, 5)) == [1, 5]
    assert (Comparison("k", "gt", 1) & ~one_of("v", "it's")).pretty() == "(k > 1 AND NOT v = 'it''s')"
    with pytest.raises(ValueError):
        Comparison("k", "ilike", "x")


def test_like(spark):
    df = frame(spark, [("a\nb",), ("a\\b",), ("axb",), (None,)], "s string")
    hits = lambda p, **o: {r.s for r in df.where(Comparison("s", "like", p).to_column(options=Options(**o))).collect()}
    assert hits("a%b") == {"a\nb", "a\\b", "axb"}
    assert hits("a%b", strict_like=True) == {"a\\b", "axb"}
    assert hits("a\\b") == {"a\\b"} == hits("a\\b", strict_like=True)
    assert like_regex("a.b") == r"(?d)\Aa\.b\z"


CATALOG = {"t": ["id", "v"], "u": ["id", "w"]}


def test_sql_subset():
    q = parse("SELECT MIN(a.v) AS m, w FROM t AS a, u b WHERE a.id = b.id AND (a.v = 'x' OR a.v LIKE 'y%') AND w IS NOT NULL;", CATALOG)
    assert q.outputs == [("a", "v"), ("b", "w")] and q.names == ["m", "b_w"] and set(q.filters) == {"a", "b"}
    assert q.graph.connected({"a", "b"})
    for bad in (
        "SELECT v FROM t WHERE v = 1", "SELECT * FROM t, u WHERE t.id = u.id", "SELECT id FROM t, u WHERE t.id = u.id", "SELECT t.v FROM t, u WHERE t.id < u.id",
        "SELECT t.v FROM t, u WHERE t.id = u.id OR t.v = 1", "SELECT t.v FROM t, u WHERE t.v = 1 OR u.w = 2", "SELECT t.v FROM t, x WHERE t.v = 1",
        "SELECT t.v FROM t, t WHERE t.v = 1", "SELECT t.z FROM t, u WHERE t.v = 1", "SELECT t.v FROM t, u WHERE 1 = t.v", "SELECT t.v FROM t, u WHERE t.v = 1 GROUP BY t.v",
    ):
        with pytest.raises(SqlError):
            parse(bad, CATALOG)
    assert strip_functions("SELECT MIN(a.x) AS m, b FROM t") == "SELECT a.x, b FROM t"


def test_join_graph_closure():
    q = parse("SELECT a.v FROM t a, t b, t c WHERE a.id = b.id AND b.id = c.id", CATALOG)
    assert frozenset("ac") in q.graph.edges() and q.graph.conditions({"a"}, {"c"}) == [(("a", "id"), ("c", "id"))]


def node(kind, *below, **more):
    return {"Node Type": kind, "Plans": list(below), **more}


def test_plan_import_errors(spark):
    tables = {"t": frame(spark, [(1, "x")], "id int, v string"), "u": frame(spark, [(1, "y")], "id int, w string")}
    q = parse("SELECT a.v, b.w FROM t a, u b WHERE a.id = b.id", {k: v.columns for k, v in tables.items()})
    a, b = (node("Seq Scan", **{"Relation Name": r, "Alias": x}) for r, x in (("t", "a"), ("u", "b")))
    assert import_plan(node("Hash Join", a, node("Hash", b)), q, tables, True).collect() == [("x", "y")]
    for bad in (node("Nested Loop", a, b), node("Merge Join", a, b), node("Hash Join", a, b), node("Hash Join", node("Hash", a), node("Hash", b)), node("Sort", a), node("Seq Scan", Alias="z")):
        with pytest.raises(PlanError):
            import_plan(bad, q, tables)


def read(spark, tmp_path, text, **options):
    (tmp_path / "x.csv").write_bytes(text.encode())
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    return [tuple(r) for r in files.read_csv(spark, schema, str(tmp_path / "x.csv"), **options).collect()]


def test_csv(spark, tmp_path):
    assert read(spark, tmp_path, '1,""\n2,\n,x\n') == [(1, None), (2, None), (None, "x")]
    assert read(spark, tmp_path, '3,"x\\"y"\n') == [(3, 'x"y')]
    assert read(spark, tmp_path, '3,"a""b"\n', escape='"') == [(3, 'a"b')]
    assert read(spark, tmp_path, '1,"a,b"\r\n2,"c\nd"') == [(1, "a,b"), (2, "c\nd")]
    assert read(spark, tmp_path, "1|a|\n2|b|\n", sep="|", trailing_sep=True) == [(1, "a"), (2, "b")]
    assert read(spark, tmp_path, "a,b\n1,x\n", header=True) == [(1, "x")]
    assert read(spark, tmp_path, f"1,{'y' * 20000}\n") == [(1, "y" * 20000)]
    for bad in ("x,y\n", "1,2,3\n"):
        with pytest.raises(Exception):
            read(spark, tmp_path, bad)


def test_printed_rows(spark):
    df = frame(spark, [(1, 'a"b\n'), (None, None)], "k int, v string")
    assert [r.line for r in files.format_rows(df).collect()] == ['1|"a\\"b\\n"', "NULL|NULL"]


def test_bag_difference(spark):
    a, b = frame(spark, ints(1, 1, 2)), frame(spark, ints(1, 2, 2))
    assert bag_difference(a, a) == [] and bag_difference(a, b) == ["2 distinct rows differ, 2 counting repeats"]
    assert bag_difference(a, b.withColumn("x", F.lit(1))) and bag_difference(a, frame(spark, [(1,)], "k bigint"))


def test_movie_schema_queries_analyse(spark):
    catalog = Catalog(spark)
    for name, schema in movie_schemas().items():
        catalog.register(name, spark.createDataFrame([], schema))
    text = "SELECT MIN(t.title) AS m FROM title AS t, movie_keyword AS mk, keyword AS k WHERE t.id = mk.movie_id AND mk.keyword_id = k.id AND k.keyword LIKE '%sequel%' AND t.production_year > 2005"
    assert run_sql(spark, text, "raw", True, catalog.columns()).count() == 0
    assert run_sql(spark, text, "agg").collect()[0][0] is None
    assert len(movie_schemas()) == 21


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_match_duckdb(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    order = [df.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[i] for i in order)) for r in df.collect()) == sorted(repr(r) for r in want.fetchall())


def test_filters_reach_the_scan(spark):
    plan = queries.QUERIES["filter_eq_int"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_nationkey), EqualTo(c_nationkey,5)]" in plan and "c_acctbal" not in plan
