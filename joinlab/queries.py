"""Queries over the driver's tables, one or more for each operator of the survey, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlab.functions.predicates import Comparison, Not, Options, between, one_of
from joinlab.operators.compare import bag_difference
from joinlab.plans.explain_import import import_plan
from joinlab.plans.plan import Plan
from joinlab.plans.sql_subset import parse, run_sql
from joinlab.sources import files
from joinlab.sources.catalog import parquet_table

QUERIES, ORACLES = {}, {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return parquet_table(spark, f"{sf_dir}/{name}.parquet")


def _query(name: str, oracle: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


def _scan(name: str, table: str, *columns: str) -> None:
    """Columns of a table through a one-node plan."""

    def run(spark, sf_dir):
        df, plan = _t(spark, sf_dir, table), Plan()
        plan.scan(plan.add_input(df), [df.columns.index(c) for c in columns])
        return plan.execute(columns)

    _query(name, f"SELECT {', '.join(columns)} FROM {table}")(run)


_scan("scan_project", "nation", "n_name", "n_regionkey")
_scan("scan_reorder", "part", "p_size", "p_partkey", "p_name")


@_query("inline_table", "SELECT * FROM (VALUES (1, 'xxx'), (1, 'yyy'), (NULL, 'zzz'), (2, NULL)) AS t(k, v)")
def inline_table(spark, sf_dir):
    return spark.createDataFrame([(1, "xxx"), (1, "yyy"), (None, "zzz"), (2, None)], "k int, v string")


@_query("csv_roundtrip", "SELECT * FROM customer")
def csv_roundtrip(spark, sf_dir):
    df, path = _t(spark, sf_dir, "customer"), files.work_path(spark, "csv")
    files.write_csv(df, path)
    return files.read_csv(spark, df.schema, path)


@_query("csv_pipe_sep", "SELECT * FROM supplier")
def csv_pipe_sep(spark, sf_dir):
    df, path = _t(spark, sf_dir, "supplier"), files.work_path(spark, "csv")
    files.write_csv(df, path, sep="|", trailing_sep=True)
    return files.read_csv(spark, df.schema, path, sep="|", trailing_sep=True)


@_query("cache_roundtrip", "SELECT * FROM orders WHERE o_orderstatus = 'F'")
def cache_roundtrip(spark, sf_dir):
    return files.cached(_t(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), files.work_path(spark, "cache"))


@_query("print_format", "SELECT concat(r_regionkey, '|\"', r_name, '\"') AS line FROM region")
def print_format(spark, sf_dir):
    return files.format_rows(_t(spark, sf_dir, "region").select("r_regionkey", "r_name"))


def _filter(name: str, table: str, predicate, columns: str, where: str, options: Options = Options(), derive: dict[str, str] | None = None) -> None:
    """``derive`` adds columns as SQL that both engines read, as for NULLs that the tables lack."""
    extra = "".join(f", {e} AS {c}" for c, e in (derive or {}).items())

    def run(spark, sf_dir):
        df = _t(spark, sf_dir, table)
        df = df.withColumns({c: F.expr(e) for c, e in (derive or {}).items()}) if derive else df
        return df.where(predicate.to_column(F.col, options)).select(*columns.split(", "))

    _query(name, f"SELECT {columns} FROM (SELECT *{extra} FROM {table}) AS t WHERE {where}")(run)


C = Comparison
_filter("filter_eq_int", "customer", C("c_nationkey", "eq", 5), "c_custkey, c_nationkey", "c_nationkey = 5")
_filter("filter_eq_str", "customer", C("c_mktsegment", "eq", "BUILDING"), "c_custkey, c_mktsegment", "c_mktsegment = 'BUILDING'")
_filter("filter_neq", "orders", C("o_orderstatus", "neq", "F"), "o_orderkey, o_orderstatus", "o_orderstatus <> 'F'")
_filter("filter_lt", "part", C("p_size", "lt", 10), "p_partkey, p_size", "p_size < 10")
_filter("filter_lt_str", "orders", C("o_orderpriority", "lt", "3"), "o_orderkey, o_orderpriority", "o_orderpriority < '3'")
_filter("filter_gt", "lineitem", C("l_quantity", "gt", 45.0), "l_orderkey, l_linenumber, l_quantity", "l_quantity > 45.0")
_filter("filter_le", "orders", C("o_totalprice", "leq", 150000.0), "o_orderkey, o_totalprice", "o_totalprice <= 150000.0")
_filter("filter_ge", "customer", C("c_acctbal", "geq", 9000.0), "c_custkey, c_acctbal", "c_acctbal >= 9000.0")
for _name, _pattern in {"prefix": "blue%", "suffix": "%widget", "infix": "%n%", "multi": "%l%e%t%", "underscore": "c_ld %"}.items():
    _filter(f"filter_like_{_name}", "part", C("p_name", "like", _pattern), "p_partkey, p_name", f"p_name LIKE '{_pattern}'")
_filter("filter_not_like", "part", C("p_name", "not_like", "%widget%"), "p_partkey, p_name", "p_name NOT LIKE '%widget%'")
_filter("filter_like_newline", "documents", C("text", "like", "%the%"), "doc_id", "regexp_full_match(text, '.*the.*')", Options(strict_like=True))
_null = {"k": "nullif(c_nationkey, 3)"}
_filter("filter_is_null", "customer", C("k", "is_null"), "c_custkey, k", "k IS NULL", derive=_null)
_filter("filter_is_not_null", "customer", C("k", "is_not_null"), "c_custkey, k", "k IS NOT NULL", derive=_null)
_filter("filter_between_int", "part", between("p_size", 10, 20), "p_partkey, p_size", "p_size BETWEEN 10 AND 20")
_filter("filter_between_str", "orders", between("o_orderpriority", "2", "4"), "o_orderkey, o_orderpriority", "o_orderpriority BETWEEN '2' AND '4'")
_filter("filter_in_int", "customer", one_of("c_nationkey", 1, 4, 9), "c_custkey, c_nationkey", "c_nationkey IN (1, 4, 9)")
_filter("filter_in_str", "customer", one_of("c_mktsegment", "BUILDING", "MACHINERY"), "c_custkey, c_mktsegment", "c_mktsegment IN ('BUILDING', 'MACHINERY')")
_filter("filter_and", "part", C("p_size", "gt", 10) & C("p_name", "like", "%e%"), "p_partkey", "p_size > 10 AND p_name LIKE '%e%'")
_filter("filter_or", "part", C("p_size", "lt", 5) | C("p_size", "gt", 45), "p_partkey, p_size", "p_size < 5 OR p_size > 45")
_filter("filter_not", "customer", Not(C("k", "eq", 5)), "c_custkey, k", "NOT (k = 5)", derive=_null)
_filter("filter_not_two_valued", "customer", Not(C("k", "eq", 5)), "c_custkey, k", "NOT coalesce(k = 5, false)", Options(two_valued_not=True), _null)
_filter("filter_nested", "part", (C("p_name", "like", "%blue%") | C("p_name", "like", "%green%")) & Not(between("p_size", 10, 30)) & C("p_brand", "neq", "x"),
        "p_partkey, p_name, p_size", "(p_name LIKE '%blue%' OR p_name LIKE '%green%') AND NOT (p_size BETWEEN 10 AND 30) AND p_brand <> 'x'")


def _join(name: str, left: str, right: str, on: str, columns: str, build_left: bool = True, honour: bool = False) -> None:
    """left and right: SELECTs that both engines read; on: ``a = b``; through a positional plan."""
    a, b = on.split(" = ")

    def run(spark, sf_dir):
        views = {t: _t(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders", "supplier") if t in f"{left} {right}".split()}
        x, y = (spark.sql(sql.replace(f"FROM {t}", "FROM {" + t + "}"), **{t: views[t]}) for sql, t in ((left, left.split("FROM ")[1].split()[0]), (right, right.split("FROM ")[1].split()[0])))
        plan, names = Plan(), x.columns + y.columns
        l, r = (plan.scan(plan.add_input(df), range(len(df.columns))) for df in (x, y))
        out = columns.split(", ")
        plan.join(build_left, l, r, x.columns.index(a), y.columns.index(b), [names.index(c) for c in out])
        return plan.execute(out, honour_build_side=honour)

    _query(name, f"SELECT {columns} FROM ({left}) AS l JOIN ({right}) AS r ON l.{a} = r.{b}")(run)


_NATION, _REGION = "SELECT n_nationkey, n_name, n_regionkey FROM nation", "SELECT r_regionkey, r_name FROM region"
_CUST, _ORD = "SELECT c_custkey, c_name, c_nationkey FROM customer", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"
_join("join_inner", _NATION, _REGION, "n_regionkey = r_regionkey", "n_name, r_name")
_join("join_build_left", _CUST, _ORD, "c_custkey = o_custkey", "o_orderkey, c_name", True, True)
_join("join_build_right", _ORD, _CUST, "o_custkey = c_custkey", "o_orderkey, c_name", False, True)
_join("join_project_reorder", _CUST, _ORD, "c_custkey = o_custkey", "o_totalprice, c_name, o_orderkey, c_custkey")
_join("join_dup_keys", "SELECT n_nationkey, n_regionkey FROM nation", "SELECT s_suppkey, s_nationkey % 5 AS s_mod FROM supplier", "n_regionkey = s_mod", "n_nationkey, s_suppkey")
_join("join_null_keys", "SELECT n_nationkey, nullif(n_regionkey, 2) AS a FROM nation", "SELECT s_suppkey, nullif(s_nationkey, 3) AS b FROM supplier", "a = b", "n_nationkey, s_suppkey, b")
_join("join_payload_nulls", "SELECT n_nationkey, nullif(n_name, 'NATION_4') AS v FROM nation", "SELECT c_custkey, c_nationkey, nullif(c_mktsegment, 'BUILDING') AS w FROM customer", "n_nationkey = c_nationkey", "v, w, c_custkey")
_join("join_empty_input", "SELECT n_nationkey, n_name FROM nation WHERE false", _CUST, "n_nationkey = c_nationkey", "n_name, c_custkey")
_join("join_empty_result", "SELECT n_nationkey + 1000 AS a, n_name FROM nation", _CUST, "a = c_nationkey", "n_name, c_custkey")


def _sql(name: str, text: str, mode: str = "agg", oracle: str | None = None) -> None:
    """The same text in both engines, after a pass of the strict subset's checks."""

    def run(spark, sf_dir):
        views = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
        for t in views:
            _t(spark, sf_dir, t).createOrReplaceTempView(t)
        return run_sql(spark, text, mode, strict=True, catalog={t: spark.table(t).columns for t in views})

    _query(name, oracle or text)(run)


_sql("join_self", "SELECT n1.n_name AS name_a, n2.n_name AS name_b FROM nation AS n1, nation AS n2 WHERE n1.n_regionkey = n2.n_regionkey AND n1.n_name = 'NATION_3'")
_sql("join_leftdeep3", "SELECT o.o_orderkey AS k, c.c_name AS c, n.n_name AS n FROM nation AS n, customer AS c, orders AS o WHERE n.n_nationkey = c.c_nationkey AND c.c_custkey = o.o_custkey")
_CHAIN = "FROM region AS r, nation AS n, customer AS c, orders AS o, lineitem AS l WHERE r.r_regionkey = n.n_regionkey AND n.n_nationkey = c.c_nationkey AND c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey AND r.r_name = 'ASIA'"
_sql("join_chain", f"SELECT n.n_name AS n, o.o_orderkey AS o, l.l_linenumber AS l, l.l_quantity AS q {_CHAIN}")
_sql("join_star", "SELECT l.l_orderkey AS o, l.l_linenumber AS l, p.p_name AS p, s.s_name AS s FROM lineitem AS l, part AS p, supplier AS s, orders AS o WHERE l.l_partkey = p.p_partkey AND l.l_suppkey = s.s_suppkey AND l.l_orderkey = o.o_orderkey AND p.p_size < 10 AND o.o_orderstatus = 'F'")
_sql("join_equiv_class", "SELECT c.c_custkey AS c, s.s_suppkey AS s, n.n_name AS n FROM customer AS c, supplier AS s, nation AS n WHERE c.c_nationkey = n.n_nationkey AND s.s_nationkey = n.n_nationkey AND c.c_nationkey = s.s_nationkey")
_sql("join_wide", "SELECT n1.n_name AS n1, n2.n_name AS n2, r1.r_name AS r1, r2.r_name AS r2, o.o_orderkey AS o, l.l_linenumber AS l, p.p_name AS p FROM region AS r1, region AS r2, nation AS n1, nation AS n2, supplier AS s, customer AS c, orders AS o, lineitem AS l, part AS p, orders AS o2 WHERE r1.r_regionkey = n1.n_regionkey AND r2.r_regionkey = n2.n_regionkey AND s.s_nationkey = n1.n_nationkey AND c.c_nationkey = n2.n_nationkey AND o.o_custkey = c.c_custkey AND l.l_orderkey = o.o_orderkey AND l.l_suppkey = s.s_suppkey AND l.l_partkey = p.p_partkey AND o2.o_orderkey = o.o_orderkey AND r1.r_name = 'ASIA' AND r2.r_name = 'EUROPE' AND p.p_size BETWEEN 1 AND 25")
_sql("select_columns", f"SELECT o.o_orderkey AS o_orderkey, c.c_name AS c_name {_CHAIN}")
_sql("select_min_agg", f"SELECT MIN(o.o_totalprice) AS min_price, MIN(c.c_name) AS min_name {_CHAIN}")
_sql("select_min_raw", f"SELECT MIN(o.o_totalprice) AS min_price, MIN(c.c_name) AS min_name {_CHAIN}", "raw", f"SELECT o.o_totalprice, c.c_name {_CHAIN}")
_ONE = f"SELECT n.n_name AS n_name, c.c_name AS c_name, o.o_orderkey AS o_orderkey, l.l_quantity AS l_quantity {_CHAIN} AND (l.l_returnflag = 'R' OR l.l_returnflag = 'A')"
_sql("select_min_oneshot", _ONE)


@_query("join_bushy4", "SELECT n_name, r_name, c_name, o_orderkey FROM nation, region, customer, orders WHERE n_regionkey = r_regionkey AND c_custkey = o_custkey AND n_nationkey = c_nationkey AND r_name = 'EUROPE'")
def join_bushy4(spark, sf_dir):
    plan = Plan()
    inputs = [_t(spark, sf_dir, t) for t in ("nation", "region", "customer", "orders")]
    inputs = [df.where("r_name = 'EUROPE'") if "r_name" in df.columns else df for df in inputs]
    picks = [("n_nationkey", "n_name", "n_regionkey"), ("r_regionkey", "r_name"), ("c_custkey", "c_name", "c_nationkey"), ("o_custkey", "o_orderkey")]
    n, r, c, o = (plan.scan(plan.add_input(df), [df.columns.index(x) for x in p]) for df, p in zip(inputs, picks, strict=True))
    left = plan.join(False, n, r, 2, 0, [0, 1, 4])
    right = plan.join(True, c, o, 0, 0, [2, 1, 4])
    plan.join(True, left, right, 0, 0, [1, 2, 4, 5])
    return plan.execute(["n_name", "r_name", "c_name", "o_orderkey"])


def _node(kind: str, *below, **more) -> dict:
    return {"Node Type": kind, **({"Plans": list(below)} if below else {}), **more}


def _leaf(table: str, alias: str) -> dict:
    return _node("Seq Scan", **{"Relation Name": table, "Alias": alias})


@_query("plan_import", f"SELECT n.n_name AS n_name, o.o_orderkey AS o_orderkey, l.l_linenumber AS l_linenumber {_CHAIN}")
def plan_import(spark, sf_dir):
    tables = {t: _t(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders", "lineitem")}
    query = parse(f"SELECT MIN(n.n_name) AS n_name, o.o_orderkey AS o_orderkey, l.l_linenumber AS l_linenumber {_CHAIN}", {t: df.columns for t, df in tables.items()})
    small = _node("Hash Join", _leaf("nation", "n"), _node("Hash", _leaf("region", "r")))
    people = _node("Hash Join", _leaf("customer", "c"), _node("Hash", small))
    orders = _node("Hash Join", _leaf("orders", "o"), _node("Hash", people))
    tree = _node("Aggregate", _node("Gather", _node("Hash Join", _leaf("lineitem", "l"), _node("Hash", orders))))
    return import_plan({"Plan": tree}, query, tables)


def _imported(name: str, text: str, *order: tuple[str, str]) -> None:
    """A left-deep tree over (table, alias) in this order, through the plan import."""

    def run(spark, sf_dir):
        tables = {t: _t(spark, sf_dir, t) for t in dict(order)}
        (t, a), *rest = order
        tree = _leaf(t, a)
        for t, a in rest:
            tree = _node("Hash Join", _leaf(t, a), _node("Hash", tree))
        return import_plan({"Plan": tree}, parse(text, {t: df.columns for t, df in tables.items()}), tables)

    _query(name, text)(run)


_imported("plan_import_equiv_class", "SELECT c.c_custkey AS c, s.s_suppkey AS s, n.n_name AS n FROM customer AS c, supplier AS s, nation AS n WHERE c.c_nationkey = n.n_nationkey AND s.s_nationkey = n.n_nationkey AND c.c_nationkey = s.s_nationkey", ("supplier", "s"), ("customer", "c"), ("nation", "n"))
_imported("plan_import_same_alias", "SELECT n.n_nationkey AS n, n.n_name AS name, r.r_name AS r FROM nation AS n, region AS r WHERE n.n_regionkey = r.r_regionkey AND n.n_nationkey = r.r_regionkey", ("nation", "n"), ("region", "r"))
_imported("plan_import_two_columns", "SELECT c.c_custkey AS c, o.o_orderkey AS o, n.n_name AS n FROM customer AS c, orders AS o, nation AS n WHERE c.c_custkey = o.o_custkey AND c.c_nationkey = n.n_nationkey AND n.n_regionkey = c.c_nationkey", ("nation", "n"), ("customer", "c"), ("orders", "o"))
_filter("filter_in_long", "orders", one_of("o_orderkey", *range(0, 9000, 3)), "o_orderkey, o_totalprice", "o_orderkey < 9000 AND o_orderkey >= 0 AND o_orderkey % 3 = 0")
_filter("filter_strict_types", "customer", C("c_name", "eq", 5) | C("c_nationkey", "eq", 7), "c_custkey, c_nationkey", "c_nationkey = 7", Options(strict_types=True))


@_query("compare_bags", "SELECT '1 distinct rows differ, 1 counting repeats' AS difference")
def compare_bags(spark, sf_dir):
    nation = _t(spark, sf_dir, "nation")
    return spark.createDataFrame([(x,) for x in bag_difference(nation, nation.unionByName(nation.orderBy("n_nationkey").limit(1)))], "difference string")


@_query("predicate_text", "SELECT '((p_size > 10 AND NOT p_name LIKE ''%e%'') OR p_brand IS NULL)' AS text")
def predicate_text(spark, sf_dir):
    return spark.createDataFrame([(((C("p_size", "gt", 10) & Not(C("p_name", "like", "%e%"))) | C("p_brand", "is_null")).pretty(),)], "text string")
