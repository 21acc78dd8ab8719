"""The registered queries of the engine's own operators, and their oracle SQL (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.cel.compiler import cel, duration_micros
from loomwright.functions import geo, jq, text
from loomwright.functions.actions import Registry
from loomwright.operators import paging, search
from loomwright.operators.predicate import Edge, Relations
from loomwright.plans import flow, user
from loomwright.plans.sqlservice import SqlService, expose
from loomwright.sources import notify, readers, writers
from loomwright.storage import shared_path
from loomwright.streaming import schedule, streams
from loomwright.types import valid_row

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
EDGES = {
    ("orders", "Customer"): Edge("customer", "o_custkey", "c_custkey", unique=True, required=True), ("orders", "Lineitems"): Edge("lineitem", "o_orderkey", "l_orderkey"),
    ("customer", "Orders"): Edge("orders", "c_custkey", "o_custkey"), ("customer", "Nation"): Edge("nation", "c_nationkey", "n_nationkey", unique=True, required=True),
    ("nation", "Region"): Edge("region", "n_regionkey", "r_regionkey", unique=True, required=True), ("nation", "Customers"): Edge("customer", "n_nationkey", "c_nationkey"),
    ("lineitem", "Order"): Edge("orders", "l_orderkey", "o_orderkey", unique=True), ("lineitem", "Part"): Edge("part", "l_partkey", "p_partkey", unique=True), ("lineitem", "Supplier"): Edge("supplier", "l_suppkey", "s_suppkey", unique=True),
    ("part", "Lineitems"): Edge("lineitem", "p_partkey", "l_partkey"), ("supplier", "Nation"): Edge("nation", "s_nationkey", "n_nationkey", unique=True),
}


def query(sql: str | None = None):
    """Register a function as a query under its name, with oracle SQL where there is some."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star(spark: SparkSession, sf_dir: str) -> Relations:
    return Relations({t: read(spark, sf_dir, t) for t in STAR}, EDGES)


def service(spark: SparkSession, sf_dir: str, accessible: dict | None = None) -> SqlService:
    return SqlService(spark, {t: read(spark, sf_dir, t) for t in STAR}, accessible)


# scans


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity LIMIT 50 OFFSET 100")
def scan_select_offset(spark, sf_dir):
    return readers.read_rows(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], 100, 50, ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])


@query("SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS row FROM region")
def scan_json_rows(spark, sf_dir):
    return readers.json_rows(read(spark, sf_dir, "region").select("r_regionkey", "r_name"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_id, count(*) AS total_rows FROM {t}" for t in STAR))
def table_stats(spark, sf_dir):
    return readers.table_stats({t: read(spark, sf_dir, t) for t in STAR})


#: The tables' columns and their kinds, as they are given.
COLUMNS = {
    "region": "r_regionkey INT32, r_name STRING", "nation": "n_nationkey INT32, n_name STRING, n_regionkey INT32", "customer": "c_custkey INT64, c_name STRING, c_nationkey INT32, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey INT64, s_name STRING, s_nationkey INT32, s_acctbal DOUBLE", "part": "p_partkey INT64, p_name STRING, p_brand STRING, p_type STRING, p_size INT32, p_retailprice DOUBLE",
    "orders": "o_orderkey INT64, o_custkey INT64, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority STRING",
    "lineitem": "l_orderkey INT64, l_partkey INT64, l_suppkey INT64, l_linenumber INT32, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP",
    "events": "event_id INT64, ts TIMESTAMP, user_id INT64, event_type STRING, value DOUBLE, props STRING", "documents": "doc_id INT64, text STRING, lang STRING, source STRING, n_chars INT64", "embeddings": "vec_id INT64, embedding FLOAT[], label INT32",
    "pages": "page_id INT64, url STRING, html STRING", "benchmark": "item_id INT64, text STRING", "labels": "doc_id INT64, quality INT32, toxic INT32", "conversations": "conv_id INT64, turn INT64, role STRING, text STRING",
}
COLUMN_ROWS = ", ".join(f"('{t}', '{c.split()[0]}', {i}, '{c.split()[1].removesuffix('[]')}', true, {str(c.endswith('[]')).lower()})" for t, cs in COLUMNS.items() for i, c in enumerate(cs.split(", ")))


@query(f"SELECT * FROM (VALUES {COLUMN_ROWS}) t(table_id, \"column\", ordinal, kind, nullable, repeated)")
def catalog_columns(spark, sf_dir):
    return readers.describe(spark, {t: read(spark, sf_dir, t) for t in COLUMNS}).drop("native")


# where inputs


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' AND o_custkey IN (1,2,3,5,8,13,21,34,55,89)")
def where_eq_neq_in(spark, sf_dir):
    return star(spark, sf_dir).filter("orders", {"o_orderstatus": "F", "o_orderpriorityNEQ": "1-URGENT", "o_custkeyIn": [1, 2, 3, 5, 8, 13, 21, 34, 55, 89]}).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 150000 AND o_orderkey > 100 AND o_custkey NOT IN (1, 2, 3)")
def where_range(spark, sf_dir):
    return star(spark, sf_dir).filter("orders", {"o_totalpriceGTE": 100000, "o_totalpriceLT": 150000, "o_orderkeyGT": 100, "o_custkeyNotIn": [1, 2, 3]}).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_name FROM part WHERE (starts_with(p_name, 'a') OR ends_with(p_name, 'e') OR contains(p_name, 'lo')) AND NOT contains(p_type, 'TIN')")
def where_string_ops(spark, sf_dir):
    return star(spark, sf_dir).filter("part", {"or": [{"p_nameHasPrefix": "a"}, {"p_nameHasSuffix": "e"}, {"p_nameContains": "lo"}], "not": {"p_typeContains": "TIN"}}).select("p_partkey", "p_name")


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_mktsegment) = 'building' OR contains(lower(c_name), 'customer#00000001')")
def where_fold(spark, sf_dir):
    return star(spark, sf_dir).filter("customer", {"or": [{"c_mktsegmentEqualFold": "BuildinG"}, {"c_nameContainsFold": "CUSTOMER#00000001"}]}).select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IS NOT NULL AND NOT (c_acctbal IS NULL)")
def where_nil(spark, sf_dir):
    return star(spark, sf_dir).filter("customer", {"c_mktsegmentNotNil": True, "not": {"c_acctbalIsNil": True}}).select("c_custkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_quantity < 5 OR (l_discount >= 0.05 AND NOT l_returnflag = 'N')) AND l_linenumber = 1")
def where_bool_tree(spark, sf_dir):
    return star(spark, sf_dir).filter("lineitem", {"or": [{"l_quantityLT": 5}, {"and": [{"l_discountGTE": 0.05}, {"not": {"l_returnflag": "N"}}]}], "l_linenumber": 1}).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def edge_exists(spark, sf_dir):
    return star(spark, sf_dir).filter("customer", {"hasOrders": True}).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def edge_not_exists(spark, sf_dir):
    return star(spark, sf_dir).filter("customer", {"hasOrders": False}).select("c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def edge_with(spark, sf_dir):
    return star(spark, sf_dir).filter("customer", {"hasOrdersWith": [{"o_totalpriceGT": 200000}]}).select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000 AND EXISTS (SELECT 1 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING' AND r_name = 'ASIA') ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def edge_with_nested(spark, sf_dir):
    where = {"o_orderstatus": "F", "o_totalpriceGTE": 1000, "hasCustomerWith": [{"c_mktsegment": "BUILDING", "hasNationWith": [{"hasRegionWith": [{"r_name": "ASIA"}]}]}]}
    found = star(spark, sf_dir).filter("orders", where).select("o_orderkey", "o_custkey", "o_totalprice")
    return paging.keyset(found, [("o_totalprice", True), ("o_orderkey", False)], first=20)


@query("SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def edge_under_or(spark, sf_dir):
    return star(spark, sf_dir).filter("customer", {"or": [{"c_acctbalLT": 0}, {"not": {"hasOrdersWith": [{"o_orderstatus": "O"}]}}]}).select("c_custkey")


@query("SELECT c_custkey, o_orderkey, o_totalprice, rank FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) ON o_custkey = c_custkey WHERE rank <= 3")
def edge_children_topn(spark, sf_dir):
    r = star(spark, sf_dir)
    return r.children("customer", "Orders", r.tables["customer"], 3, [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("c_custkey", "o_orderkey", "o_totalprice", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_orderkey, c_name AS customer FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def edge_parent_lookup(spark, sf_dir):
    r = star(spark, sf_dir)
    return r.parent("orders", "Customer", r.tables["orders"], {"c_name": "customer"}).select("o_orderkey", "customer")


# counts and pages


@query("SELECT count(*) AS total_count FROM orders WHERE o_totalprice > 100000")
def total_count(spark, sf_dir):
    return star(spark, sf_dir).filter("orders", {"o_totalpriceGT": 100000}).agg(F.count("*").alias("total_count"))


@query("SELECT c_custkey, count(o_orderkey) AS orders_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey ORDER BY orders_count DESC, c_custkey LIMIT 25")
def order_by_relation_count(spark, sf_dir):
    r = star(spark, sf_dir)
    return paging.keyset(r.count_edge("customer", "Orders", r.tables["customer"].select("c_custkey"), "orders_count"), [("orders_count", True), ("c_custkey", False)], first=25)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 150000 OR (o_totalprice = 150000 AND o_orderkey > 10) ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def page_keyset(spark, sf_dir):
    return paging.keyset(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", True), ("o_orderkey", False)], first=30, after=[150000.0, 10])


@query("SELECT * FROM (SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey < 50 OR (o_custkey = 50 AND o_orderkey < 3000) ORDER BY o_custkey DESC, o_orderkey DESC LIMIT 15)")
def page_backward(spark, sf_dir):
    return paging.keyset(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), [("o_custkey", False), ("o_orderkey", False)], last=15, before=[50, 3000])


@query("SELECT o_orderkey, (SELECT count(*) FROM orders) AS total_rows, (SELECT CAST(ceil(count(*) / 40.0) AS BIGINT) FROM orders) AS total_pages FROM orders ORDER BY o_orderkey LIMIT 40 OFFSET 80")
def page_total(spark, sf_dir):
    return paging.numbered_page(read(spark, sf_dir, "orders").select("o_orderkey"), [("o_orderkey", False)], 40, 3)


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10 OFFSET 20")
def page_offset(spark, sf_dir):
    return paging.offset_page(read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), [("p_retailprice", True), ("p_partkey", False)], 10, 20)


@query("SELECT o_orderpriority AS \"table\", count(*) AS rows_written FROM orders GROUP BY 1")
def rows_written_per_table(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("table"), "o_orderkey")
    return writers.write_rows(rows, shared_path(spark, "rows"))


# SQL


PARAM = "SELECT c_mktsegment, count(*) AS n, CAST(sum(c_acctbal) AS DECIMAL(18,2)) AS total FROM customer WHERE c_acctbal > {} GROUP BY c_mktsegment"


@query(PARAM.format("1000.0"))
def sql_param_query(spark, sf_dir):
    return service(spark, sf_dir).run(PARAM.format(":least"), {"least": 1000.0})


JOINS = """SELECT 'inner' AS kind, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey UNION ALL SELECT 'left', count(*) FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000
UNION ALL SELECT 'right', count(*) FROM orders RIGHT JOIN customer ON c_custkey = o_custkey UNION ALL SELECT 'full', count(*) FROM supplier FULL JOIN customer ON s_nationkey = c_nationkey AND s_acctbal > c_acctbal
UNION ALL SELECT 'cross', count(*) FROM region CROSS JOIN nation UNION ALL SELECT 'semi', count(*) FROM nation LEFT SEMI JOIN supplier ON n_nationkey = s_nationkey UNION ALL SELECT 'anti', count(*) FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey"""


@query(JOINS.replace("LEFT SEMI", "SEMI").replace("LEFT ANTI", "ANTI"))
def sql_join_kinds(spark, sf_dir):
    return service(spark, sf_dir).run(JOINS)


CUBE = "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS DECIMAL(18,2)) AS qty, CAST(grouping(l_returnflag) AS INT) AS g FROM lineitem GROUP BY {} (l_returnflag, l_linestatus)"


@query(CUBE.format("CUBE"))
def sql_group_cube(spark, sf_dir):
    return service(spark, sf_dir).run(CUBE.format("CUBE"))


@query(CUBE.format("ROLLUP"))
def sql_group_rollup(spark, sf_dir):
    return service(spark, sf_dir).run(CUBE.format("ROLLUP"))


WINDOW = "SELECT o_orderkey, CAST(rank() OVER w AS BIGINT) AS rnk, CAST(dense_rank() OVER w AS BIGINT) AS dense, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n3 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)"


@query(WINDOW)
def sql_window(spark, sf_dir):
    return service(spark, sf_dir).run(WINDOW)


SETS = "(SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) EXCEPT (SELECT n_nationkey FROM nation WHERE n_regionkey = 0 INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 0)"


@query(SETS)
def sql_setops(spark, sf_dir):
    return service(spark, sf_dir).run(SETS)


LINEAGE = "SELECT c.c_name, sum(o.o_totalprice) AS total FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus = 'F' GROUP BY c.c_name"


@query("SELECT * FROM (VALUES ('customer','c_custkey'),('customer','c_name'),('orders','o_custkey'),('orders','o_orderstatus'),('orders','o_totalprice')) t(table_id, \"column\")")
def sql_lineage(spark, sf_dir):
    found = service(spark, sf_dir).validate(LINEAGE).accessed
    return spark.createDataFrame([(t, c) for t in sorted(found) for c in sorted(found[t])], "table_id string, column string")


@query("SELECT * FROM (VALUES ('allowed', true, ''),('column', false, 'column customer.c_acctbal is not accessible'),('table', false, 'table orders is not accessible'),('syntax', false, 'error')) t(name, valid, error)")
def sql_permissions(spark, sf_dir):
    s = service(spark, sf_dir, {"customer": ["c_custkey", "c_name"]})
    asked = {"allowed": "SELECT c_name FROM customer WHERE c_custkey < 5", "column": "SELECT c_name FROM customer WHERE c_acctbal > 0", "table": "SELECT o_orderkey FROM orders", "syntax": "SELEC 1"}
    rows = [(k, (v := s.validate(q)).valid, v.error if k != "syntax" else "error") for k, q in asked.items()]
    return spark.createDataFrame(rows, "name string, valid boolean, error string")


@query("SELECT c_custkey AS id, c_name AS name FROM customer")
def sql_exposed_view(spark, sf_dir):
    return expose(read(spark, sf_dir, "customer"), {"c_custkey": "id", "c_name": "name"})


@query("SELECT c_nationkey AS nation, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def sql_models(spark, sf_dir):
    s = service(spark, sf_dir)
    s.models({"by_nation": "SELECT c_nationkey AS nation, count(*) AS n FROM rich GROUP BY 1", "rich": "SELECT * FROM customer WHERE c_acctbal > 0"})
    return spark.table("by_nation")


# flows over events: an iteration is an event, in order within its user


def run_flow(spark, sf_dir, spec: dict, columns: dict[str, str], keep=("event_id",)) -> DataFrame:
    e = read(spark, sf_dir, "events")
    df = e.select("user_id", "ts", "event_id", *[F.expr(x).alias(a) for a, x in columns.items()])
    return flow.run(spec, df, ["ts", "event_id"], ["user_id"]).drop("ts", "user_id")


def chain(n: int) -> dict:
    steps = [{"id": "step1", "value": "= inputs.seed.getValue() + 1"}] + [{"id": f"step{i}", "value": f"= vars.step{i - 1}.getValue() + 1"} for i in range(2, n + 1)]
    return {"inputs": [{"id": "seed", "int64": {"default": 1}}], "vars": steps, "outputs": [{"id": "result", "value": f"= vars.step{n}"}]}


@query("SELECT event_id, event_id + 10 AS result FROM events")
def flow_deep_chain(spark, sf_dir):
    return run_flow(spark, sf_dir, chain(10), {"seed": "event_id"})


WIDE = {"inputs": [{"id": "multiplier", "int64": {"default": 2}}], "vars": [{"id": f"calc{k}", "value": f"= inputs.multiplier.getValue() * {k}"} for k in range(1, 11)] + [{"id": "sum", "value": "= " + " + ".join(f"vars.calc{k}" for k in range(1, 11))}], "outputs": [{"id": "result", "value": "= vars.sum"}]}


@query("SELECT event_id, 55 * user_id AS result FROM events")
def flow_wide_parallel(spark, sf_dir):
    return run_flow(spark, sf_dir, WIDE, {"multiplier": "user_id"})


@query("SELECT event_id, (event_id * 2 + event_id * 3) - event_id AS result FROM events")
def flow_diamond(spark, sf_dir):
    return run_flow(spark, sf_dir, {"inputs": [{"id": "base", "int64": {}}], "vars": [{"id": "l", "value": "= inputs.base * 2"}, {"id": "r", "value": "= inputs.base * 3"}, {"id": "m", "value": "= vars.l + vars.r"}], "outputs": [{"id": "result", "value": "= vars.m - inputs.base"}]}, {"base": "event_id"})


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'low' WHEN 'purchase' THEN 'high' ELSE 'none' END AS result FROM events")
def flow_switch(spark, sf_dir):
    s = {"value": "= inputs.kind", "cases": [{"value": "click", "return": "low"}, {"value": "purchase", "return": "high"}], "default": "none"}
    return run_flow(spark, sf_dir, {"inputs": [{"id": "kind", "string": {}}], "vars": [{"id": "v", "switch": s}], "outputs": [{"id": "result", "value": "= vars.v"}]}, {"kind": "event_type"})


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS reason, event_type = 'error' AS is_error FROM events")
def flow_done(spark, sf_dir):
    spec = {"inputs": [{"id": "kind", "string": {}}], "vars": [{"id": "d", "value": "= Done{reason: inputs.kind == 'error' ? 'failed' : 'ok', is_error: inputs.kind == 'error'}"}], "outputs": [{"id": "reason", "value": "= vars.d.reason"}, {"id": "is_error", "value": "= vars.d.isError"}]}
    return run_flow(spark, sf_dir, spec, {"kind": "event_type"})


VALUE = {"inputs": [{"id": "v", "double": {}}]}


@query("SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS result FROM events")
def flow_prev(spark, sf_dir):
    return run_flow(spark, sf_dir, VALUE | {"outputs": [{"id": "result", "value": "= inputs.v.getPrev()"}]}, {"v": "value"})


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS result FROM events")
def flow_count(spark, sf_dir):
    return run_flow(spark, sf_dir, VALUE | {"outputs": [{"id": "result", "value": "= int(inputs.v.getCount())"}]}, {"v": "value"})


@query("SELECT event_id, first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS result FROM events")
def flow_cache(spark, sf_dir):
    return run_flow(spark, sf_dir, VALUE | {"vars": [{"id": "c", "value": "= inputs.v", "cache": True}], "outputs": [{"id": "result", "value": "= vars.c"}]}, {"v": "value"})


@query("SELECT event_id, CASE WHEN max(CASE WHEN value > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 THEN value END AS result FROM events")
def flow_start_if(spark, sf_dir):
    return run_flow(spark, sf_dir, VALUE | {"streams": [{"id": "s", "value": "= inputs.v", "start_if": "= inputs.v > 100.0"}], "outputs": [{"id": "result", "value": "= streams.s"}]}, {"v": "value"})


@query("SELECT event_id, CASE WHEN max(CASE WHEN value > 150 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 0 THEN value END AS result FROM events")
def flow_stop_if(spark, sf_dir):
    return run_flow(spark, sf_dir, VALUE | {"streams": [{"id": "s", "value": "= inputs.v", "stop_if": "= inputs.v > 150.0"}], "outputs": [{"id": "result", "value": "= streams.s"}]}, {"v": "value"})


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN coalesce(TRY_CAST(CASE WHEN event_id % 2 = 0 THEN 'x' ELSE CAST(event_id AS VARCHAR) END AS BIGINT), -1) END AS result FROM events")
def flow_run_if_on_error(spark, sf_dir):
    spec = {"inputs": [{"id": "t", "string": {}}, {"id": "n", "int64": {}}], "actions": [{"id": "a", "request": "= int(inputs.t)", "run_if": "= inputs.n % 3 == 0", "on_error": -1}], "outputs": [{"id": "result", "value": "= actions.a"}]}
    return run_flow(spark, sf_dir, spec, {"t": "CASE WHEN event_id % 2 = 0 THEN 'x' ELSE CAST(event_id AS STRING) END", "n": "event_id"})


@query("SELECT event_id, CAST(list_sum(list_transform(list_filter([event_id % 7, event_id % 5, 3, 4], lambda x: x > 2), lambda x: x * 2)) AS BIGINT) AS result FROM events WHERE len(list_filter([event_id % 7, event_id % 5, 3, 4], lambda x: x > 2)) > 0")
def flow_list_expr(spark, sf_dir):
    spec = {"inputs": [{"id": "xs", "list": {"items": "int64"}}], "vars": [{"id": "f", "value": "= inputs.xs.filter(x, x > 2)"}, {"id": "m", "value": "= vars.f.map(x, x * 2)"}], "outputs": [{"id": "doubled", "value": "= vars.m"}]}
    out = run_flow(spark, sf_dir, spec, {"xs": "array(event_id % 7, event_id % 5, 3L, 4L)"})
    return out.select("event_id", F.aggregate("doubled", F.lit(0).cast("long"), lambda a, x: a + x).alias("result"))


# CEL


def with_cel(df: DataFrame, keys: list[str], **exprs: str) -> DataFrame:
    return df.select(*keys, *[cel(df, e).alias(a) for a, e in exprs.items()])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey // 7 AS q, l_orderkey % 7 AS r, -l_orderkey + l_partkey * 2 AS e, l_quantity / 4.0 AS d, CASE WHEN l_discount = 0 THEN true ELSE false END AS inf FROM lineitem")
def cel_arith(spark, sf_dir):
    return with_cel(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], q="l_orderkey / 7", r="l_orderkey % 7", e="-l_orderkey + l_partkey * 2", d="l_quantity / 4.0", inf="1.0 / l_discount > 1e300")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN true ELSE false END AS a, CASE WHEN event_id % 2 = 0 THEN false ELSE event_type = 'click' END AS b FROM events")
def cel_compare_null(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 1, F.col("event_type")).alias("t"))
    return with_cel(e, ["event_id"], a="t == null", b="t == 'click'")


@query("SELECT event_id, false AS a, true AS b, CASE WHEN event_id % 5 = 0 THEN false ELSE 10 // (event_id % 5) > 2 END AS c FROM events")
def cel_bool_absorb(spark, sf_dir):
    return with_cel(read(spark, sf_dir, "events"), ["event_id"], a="(1 / (event_id - event_id) > 1) && false", b="true || 1 / (event_id - event_id) > 1", c="event_id % 5 != 0 && 10 / (event_id % 5) > 2")


@query("SELECT event_id, CAST(len(list_filter([event_id % 2, event_id % 3, event_id % 5], lambda x: x > 1)) AS BIGINT) AS n, event_id % 2 > 0 AND event_id % 3 > 0 AND event_id % 5 > 0 AS every, event_id % 2 = 2 OR event_id % 3 = 2 OR event_id % 5 = 2 AS any, (event_id % 2 = 1)::INT + (event_id % 3 = 1)::INT + (event_id % 5 = 1)::INT = 1 AS one FROM events")
def cel_list_macros(spark, sf_dir):
    l = "[event_id % 2, event_id % 3, event_id % 5]"
    return with_cel(read(spark, sf_dir, "events"), ["event_id"], n=f"size({l}.filter(x, x > 1))", every=f"{l}.all(x, x > 0)", any=f"{l}.exists(x, x == 2)", one=f"{l}.exists_one(x, x == 1)")


@query("SELECT event_id, event_type AS a, CASE WHEN event_type = 'click' THEN true ELSE false END AS b, CAST(1 AS BIGINT) AS n FROM events")
def cel_map(spark, sf_dir):
    return with_cel(read(spark, sf_dir, "events"), ["event_id"], a="{'kind': event_type}.kind", b="'click' in {event_type: 1}", n="size({event_type: 1})")


@query("SELECT event_id, CAST(event_id AS VARCHAR) AS s, event_id + 1 AS i, CAST(event_id AS DOUBLE) / 2 AS d, CAST(trunc(value) AS BIGINT) AS t FROM events")
def cel_convert(spark, sf_dir):
    return with_cel(read(spark, sf_dir, "events"), ["event_id"], s="string(event_id)", i="int(string(event_id)) + 1", d="double(event_id) / 2.0", t="int(value)")


@query("SELECT event_id, year(ts) AS y, month(ts) - 1 AS m, day(ts) - 1 AS d, dayofweek(ts) AS w, dayofyear(ts) - 1 AS doy, hour(ts) AS h, hour(ts + INTERVAL 90 MINUTE) AS later FROM events")
def cel_time(spark, sf_dir):
    return with_cel(read(spark, sf_dir, "events"), ["event_id"], y="ts.getFullYear()", m="ts.getMonth()", d="ts.getDayOfMonth()", w="ts.getDayOfWeek()", doy="ts.getDayOfYear()", h="ts.getHours()", later="(ts + duration('1h30m')).getHours()")


@query("""SELECT p_partkey, substr(p_name, 2, 1) AS ch, CAST(strpos(p_name, 'e') - 1 AS BIGINT) AS idx, upper(p_name) AS up, replace(p_name, 'a', 'A') AS rep, CAST(len(string_split(p_name, ' ')) AS BIGINT) AS parts, substr(p_name, 1, 3) AS head, reverse(p_name) AS rev, contains(p_name, 'ee') AS has, '"' || p_brand || '"' AS quoted,
printf('%05d-%s', p_size, p_brand) AS fmt FROM part""")
def cel_strings(spark, sf_dir):
    return with_cel(read(spark, sf_dir, "part"), ["p_partkey"], ch="p_name.charAt(1)", idx="p_name.indexOf('e')", up="p_name.upperAscii()", rep="p_name.replace('a', 'A')", parts="size(p_name.split(' '))", head="p_name.substring(0, 3)", rev="p_name.reverse()", has="p_name.contains('ee')", quoted="strings.quote(p_brand)", fmt="'%05d-%s'.format([p_size, p_brand])")


@query("SELECT event_id, CAST(list_sum(range(event_id % 5 + 1)) AS BIGINT) AS total, list_sort([event_id % 3, event_id % 7, 2])[1] AS least, CAST(len(list_distinct([event_id % 2, event_id % 3, 1])) AS BIGINT) AS n FROM events")
def cel_lists(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.aggregate(cel(e, "lists.range(event_id % 5 + 1)"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), cel(e, "[event_id % 3, event_id % 7, 2].sort()[0]").alias("least"), cel(e, "size([event_id % 2, event_id % 3, 1].distinct())").alias("n"))


@query("SELECT p_partkey, to_base64(CAST(p_brand AS BLOB)) AS e, p_brand AS d FROM part")
def cel_encoders(spark, sf_dir):
    return with_cel(read(spark, sf_dir, "part"), ["p_partkey"], e="base64.encode(bytes(p_brand))", d="string(base64.decode(base64.encode(bytes(p_brand))))")


@query(r"SELECT page_id, coalesce(regexp_extract(url, '^([a-z]+)://', 1), '') AS scheme, coalesce(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1), '') AS host, coalesce(regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1), '') AS path, url IS NOT NULL AS ok FROM pages")
def cel_url(spark, sf_dir):
    return with_cel(read(spark, sf_dir, "pages"), ["page_id"], scheme="url(url).getScheme()", host="url(url).getHostname()", path="url(url).getEscapedPath()", ok="isURL(url)")


# functions


@query("SELECT p_partkey, lower(replace(p_type, ' ', '_')) AS snake, lower(replace(p_type, ' ', '-')) AS slug FROM part")
def text_case_slug(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.snake(F.col("p_type")).alias("snake"), text.slugify(F.col("p_type")).alias("slug"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')) AS tidy FROM documents")
def text_tidy(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.tidy(F.col("text")).alias("tidy"))


@query("SELECT p_partkey, regexp_extract(p_brand, '([A-Za-z]+)#?([0-9]*)', 1) AS word, regexp_extract(p_brand, '([A-Za-z]+)#?([0-9]*)', 2) AS digits FROM part")
def text_regex_groups(spark, sf_dir):
    g = text.regex_groups(F.col("p_brand"), "([A-Za-z]+)#?([0-9]*)", ["word", "digits"])
    return read(spark, sf_dir, "part").select("p_partkey", F.element_at(g, "word").alias("word"), F.element_at(g, "digits").alias("digits"))


@query("SELECT o_orderkey, 'customers/' || o_custkey AS parent, CAST(o_orderkey AS VARCHAR) AS short FROM orders")
def text_resource_name(spark, sf_dir):
    n = F.concat_ws("/", F.lit("customers"), F.col("o_custkey").cast("string"), F.lit("orders"), F.col("o_orderkey").cast("string"))
    return read(spark, sf_dir, "orders").select("o_orderkey", text.name_parent(n).alias("parent"), text.name_short(n).alias("short"))


@query("SELECT doc_id, 'SHA256:' || sha256(text) AS h, substr(sha256(text), 1, 12) AS short FROM documents")
def hash_sha256(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.sha256(F.col("text")).alias("h"), text.sha256_short(F.col("text")).alias("short"))


#: FNV-1a in whole numbers: the offset basis, then (h xor byte) * prime modulo 2^64 for each byte (names are ASCII).
FNV = "list_reduce(list_prepend(14695981039346656037::UBIGINT, list_transform(string_split(p_name, ''), lambda c: ord(c)::UBIGINT)), lambda a, b: ((xor(a, b)::HUGEINT * 1099511628211) % 18446744073709551616)::UBIGINT)"


@query(f"SELECT p_partkey, format('{{:x}}', {FNV}) AS h, substr(format('{{:x}}', {FNV}), 1, 12) AS short FROM part")
def hash_fnv1a(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.fnv1a(F.col("p_name")).alias("h"), text.fnv1a_short(F.col("p_name")).alias("short"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_path(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", text.json_path(F.col("props"), "$.k", "bigint").alias("k"))


PART_SCHEMA = {"type": "object", "properties": {"p_size": {"type": "integer", "minimum": 10, "maximum": 40}, "p_name": {"type": "string", "minLength": 5, "pattern": "a"}}, "required": ["p_name"]}


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 40 AND len(p_name) >= 5 AND contains(p_name, 'a')")
def json_schema_validate(spark, sf_dir):
    return read(spark, sf_dir, "part").where(valid_row(PART_SCHEMA)).select("p_partkey")


@query("SELECT event_id, event_type AS a, 'right' AS b FROM events")
def merge_maps(spark, sf_dir):
    m = text.merge_maps(F.create_map(F.lit("a"), F.col("event_type"), F.lit("b"), F.lit("left")), F.create_map(F.lit("b"), F.lit("right")))
    return read(spark, sf_dir, "events").select("event_id", F.element_at(m, "a").alias("a"), F.element_at(m, "b").alias("b"))


@query("SELECT event_id, strftime(ts + INTERVAL 16500 SECOND, '%Y-%m-%d %H:%M:%S') AS later FROM events")
def duration_add(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.date_format(cel(e, "ts + duration('4h35m')"), "yyyy-MM-dd HH:mm:ss").alias("later"))


@query("SELECT event_id, (event_id % 7) * 3600000000 + (user_id % 60) * 60000000 + CAST((event_id % 100) * 250000 AS BIGINT) AS micros, -(event_id % 5) * 1000000 AS back FROM events")
def duration_parse(spark, sf_dir):
    part = lambda c, unit: F.concat(c.cast("string"), F.lit(unit))
    forth = F.concat(part(F.col("event_id") % 7, "h"), part(F.col("user_id") % 60, "m"), part((F.col("event_id") % 100) / 4, "s"))
    return read(spark, sf_dir, "events").select("event_id", duration_micros(forth).alias("micros"), duration_micros(F.concat(F.lit("-"), part(F.col("event_id") % 5, "s"))).alias("back"))


@query("""SELECT doc_id, CAST(unnest(generate_series(0, len(parts) - 1)) AS INT) AS pos, unnest(parts) AS token
    FROM (SELECT doc_id, CASE WHEN parts[-1] = '' THEN parts[1:len(parts) - 1] ELSE parts END AS parts FROM (SELECT doc_id, string_split(text, '\n') AS parts FROM documents WHERE text IS NOT NULL)) WHERE len(parts) > 0""")
def blob_split_lines(spark, sf_dir):
    return readers.split_delimited(read(spark, sf_dir, "documents"), "text", "\n").select("doc_id", "pos", "token")


@query("SELECT p_name AS value FROM part")
def blob_lines_raw(spark, sf_dir):
    path = shared_path(spark, "lines")
    read(spark, sf_dir, "part").select(F.col("p_name").alias("value")).write.option("lineSep", "|").text(path)
    return readers.blob_lines(spark, path, "|", 10_000)


@query("SELECT event_id, event_type FROM events")
def blob_lines_json(spark, sf_dir):
    path = shared_path(spark, "json")
    read(spark, sf_dir, "events").select("event_id", "event_type").write.json(path)
    return readers.blob_lines(spark, path, form="json", schema="event_id long, event_type string")


@query("SELECT o_orderpriority AS \"key\", count(*) AS lines_written, CAST(sum(len(CAST(o_orderkey AS VARCHAR)) + 1) AS BIGINT) AS size FROM orders GROUP BY 1")
def blob_lines_written(spark, sf_dir):
    return writers.write_lines(read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_orderkey").cast("string").alias("value")), shared_path(spark, "keyed"))


@query("SELECT c_custkey, c_name AS opened FROM customer")
def codec_encrypted(spark, sf_dir):
    key = F.lit("0123456789abcdef")
    return read(spark, sf_dir, "customer").select("c_custkey", writers.decrypt(writers.encrypt(F.col("c_name"), key), key).alias("opened"))


@query("SELECT n_nationkey, ['AFRICA','AMERICA','ASIA','EUROPE','MIDDLE_EAST'][n_regionkey + 1] AS region FROM nation")
def codec_enum(spark, sf_dir):
    names = dict(enumerate(("REGION_AFRICA", "REGION_AMERICA", "REGION_ASIA", "REGION_EUROPE", "REGION_MIDDLE_EAST")))
    return read(spark, sf_dir, "nation").select("n_nationkey", writers.enum_name(F.col("n_regionkey"), names, "REGION").alias("region"))


# geo: points from keys


def boxes(spark, sf_dir) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 7 % 360 - 180).cast("double").alias("x"), (F.col("s_suppkey") * 11 % 180 - 90).cast("double").alias("y"))
    g = F.format_string('{"type":"Polygon","coordinates":[[[%s,%s],[%s,%s],[%s,%s],[%s,%s]]]}', *[(F.col(c) + d).cast("string") for d, e in ((0, 0), (2, 2)) for c in ("x", "y")], *[(F.col(c) + d).cast("string") for c, d in (("x", 0), ("y", 2), ("x", 0), ("y", 0))])
    return s.withColumn("g", g).withColumn("box", geo.bbox(geo.parse_geometry(F.col("g"))))


BOX_SQL = "(SELECT s_suppkey, CAST(s_suppkey * 7 % 360 - 180 AS DOUBLE) AS x, CAST(s_suppkey * 11 % 180 - 90 AS DOUBLE) AS y FROM supplier)"


@query(f"SELECT s_suppkey, x >= -90 AND y >= -45 AND x + 2 <= 90 AND y + 2 <= 45 AS covered, x <= 90 AND x + 2 >= -90 AND y <= 45 AND y + 2 >= -45 AS meets FROM {BOX_SQL}")
def geo_bounds_bbox(spark, sf_dir):
    return boxes(spark, sf_dir).select("s_suppkey", geo.covers(F.col("box"), -90, -45, 90, 45).alias("covered"), geo.intersects(F.col("box"), -90, -45, 90, 45).alias("meets"))


@query(f"SELECT s_suppkey, x AS x0, y + 2 AS y1, x + 1 AS lon, y + 1 AS lat FROM {BOX_SQL}")
def geo_bbox_center(spark, sf_dir):
    c = geo.center(F.col("box"))
    return boxes(spark, sf_dir).select("s_suppkey", F.col("box")[0].alias("x0"), F.col("box")[3].alias("y1"), c["lon"].alias("lon"), c["lat"].alias("lat"))


def interleaved(bits: int) -> list[str]:
    """SQL of the bits of a geohash of (x, y), the first from the longitude."""
    nx, ny = (bits + 1) // 2, bits // 2
    x, y = f"(floor((x + 180) / 360 * {1 << nx})::BIGINT)", f"(floor((y + 90) / 180 * {1 << ny})::BIGINT)"
    return [f"(({x if b % 2 == 0 else y} >> {(nx if b % 2 == 0 else ny) - 1 - b // 2}) & 1)" for b in range(bits)]


GEOHASH = " || ".join("substr('0123456789bcdefghjkmnpqrstuvwxyz', 1 + " + " + ".join(f"{16 >> j} * {interleaved(60)[5 * k + j]}" for j in range(5)) + ", 1)" for k in range(12))
GEONUMBER = " + ".join(f"{b}::HUGEINT * {1 << (63 - i)}::HUGEINT" for i, b in enumerate(interleaved(64)))


@query(f"SELECT s_suppkey, {GEOHASH} AS hash, CAST({GEONUMBER} AS VARCHAR) AS number FROM {BOX_SQL}")
def geo_hash(spark, sf_dir):
    return boxes(spark, sf_dir).select("s_suppkey", geo.geohash(F.col("y"), F.col("x")).alias("hash"), geo.geohash_uint64(F.col("y"), F.col("x")).cast("string").alias("number"))


@query(f"SELECT s_suppkey, x AS x0, y AS y0, x + 2 AS x1, y + 2 AS y1 FROM {BOX_SQL}")
def geo_codec_roundtrip(spark, sf_dir):
    b = geo.bbox(geo.parse_geometry(geo.from_wkb(geo.to_wkb(F.col("g")))))
    return boxes(spark, sf_dir).withColumn("b", b).select("s_suppkey", *[F.col("b")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


# search


@query("""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS word FROM documents), t AS (SELECT doc_id, word, count(*) AS tf FROM w WHERE word IN ('the', 'nicht', 'entre', 'para') GROUP BY 1, 2), d AS (SELECT word, count(*) AS df FROM t GROUP BY 1)
SELECT doc_id, round(sum(tf * ln(1 + (SELECT count(*) FROM documents) / df)), 6) AS score FROM t JOIN d USING (word) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10""")
def search_lexical(spark, sf_dir):
    return search.lexical(read(spark, sf_dir, "documents"), "doc_id", "text", "the nicht, entre PARA")


UNIT = [round((i % 7 - 3) / 10, 1) for i in range(64)]


@query(f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({UNIT} AS DOUBLE[])), 6) AS rank FROM embeddings ORDER BY rank DESC, vec_id LIMIT 10")
def search_semantic(spark, sf_dir):
    return search.semantic(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", UNIT)


@query("SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE e.vec_id <> 7 ORDER BY rank DESC, e.vec_id LIMIT 10")
def search_by_resource(spark, sf_dir):
    return search.by_resource(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 7)


@query("SELECT label, CAST(pos AS INT) AS pos, round(avg(x), 6) AS x FROM (SELECT label, unnest(range(64)) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY 1, 2")
def search_avg_vector(spark, sf_dir):
    return search.average_vectors(read(spark, sf_dir, "embeddings"), "label", "embedding").select("label", F.posexplode("vector").alias("pos", "x")).withColumn("x", F.round("x", 6))


# streams


@query("SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS tick FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-01 00:01:00', INTERVAL 5 SECOND)) AS t)")
def stream_ticker(spark, sf_dir):
    return streams.ticker(spark, "2024-01-01 00:00:00", "2024-01-01 00:01:00", "5 seconds").select(F.date_format("tick", "yyyy-MM-dd HH:mm:ss").alias("tick"))


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_event_window(spark, sf_dir):
    e = streams.file_stream(spark, f"{sf_dir}/events.parquet")
    out = streams.drain_complete(streams.windowed_counts(e, "ts", "1 day", "event_type"), "windows")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    e = streams.file_stream(spark, f"{sf_dir}/events.parquet").select("user_id", "event_type", "ts")
    return streams.drain(streams.dedup(e, ["user_id", "event_type"], "ts", "400 days").select("user_id", "event_type"), "dedup")


@query("SELECT event_id, user_id FROM (SELECT *, max(CASE WHEN value > 100 AND event_type <> 'error' THEN 1 ELSE 0 END) OVER w AS started, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS stopped FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE started = 1 AND stopped = 0")
def stream_gate(spark, sf_dir):
    return streams.gate(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value") > 100, F.col("event_type") == "error").select("event_id", "user_id")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_latest_by_key(spark, sf_dir):
    return streams.latest_by_key(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT 'eventSources/web' AS event_source, 'events/' || event_type AS event, props AS payload, CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'view' THEN 'VIEW' ELSE 'WRITE' END AS action FROM events")
def stream_envelope(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return streams.envelope(e, F.lit("eventSources/web"), F.concat(F.lit("events/"), "event_type"), F.col("props"), F.when(F.col("event_type") == "signup", "CREATE").when(F.col("event_type") == "view", "VIEW").otherwise("WRITE"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def sync_replicate(spark, sf_dir):
    return streams.replicate(spark, f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'DELETE' WHEN c_custkey % 10 = 1 THEN 'CREATE' ELSE 'UPDATE' END AS action FROM customer WHERE c_custkey % 10 < 3")
def change_feed(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    after = c.where("c_custkey % 10 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 10 == 2, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")))
    return streams.change_feed(c.where("c_custkey % 10 <> 1"), after, "c_custkey")


@query("SELECT p_partkey, CASE WHEN p_size >= 10 THEN p_size * 2 ELSE -1 END AS doubled FROM part")
def udf_action(spark, sf_dir):
    r = Registry()
    r.add("Double Size", "twice a size of at least 10", {"type": "integer", "minimum": 10}, {"type": "integer"}, lambda c: c * 2)
    return read(spark, sf_dir, "part").select("p_partkey", r.try_call("actions/double-size", F.col("p_size"), F.lit(-1)).alias("doubled"))


# jq, schedules, user actions, notifications


@query("SELECT event_id, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) > 50 THEN CAST(json_extract(props, '$.k') AS VARCHAR) END AS k, '[\"k\"]' AS names, '\"none\"' AS other FROM events")
def jq_query(spark, sf_dir):
    p = F.col("props")
    return read(spark, sf_dir, "events").select("event_id", jq.value(p, "select(.k > 50) | .k").alias("k"), jq.value(p, "keys").alias("names"), jq.value(p, '.missing // "none"').alias("other"))


@query("""SELECT event_id, 21600000000 - (epoch_us(ts) - 1704067200000000) % 21600000000 AS often,
    CASE WHEN epoch_us(ts) < 1704093300000000 THEN 1704093300000000 - epoch_us(ts) ELSE 172800000000 - (epoch_us(ts) - 1704093300000000) % 172800000000 END AS every_other_day FROM events""")
def sync_schedule(spark, sf_dir):
    """Microseconds until a source that was created on 2024-01-01 is due next: every 6 hours, and every other day at 07:15."""
    ts, anchor = F.col("ts").cast("timestamp"), F.lit("2024-01-01 00:00:00").cast("timestamp")
    wait = lambda *every: F.unix_micros(schedule.next_sync(ts, anchor, *every)) - F.unix_micros(ts)
    return read(spark, sf_dir, "events").select("event_id", wait().alias("often"), wait(2880, "07:15").alias("every_other_day"))


@query("""SELECT a.event_id, b.value AS approved, CASE WHEN b.event_id IS NULL THEN 'waiting' ELSE 'answered' END AS user_status
    FROM events a LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') b ON b.event_id = a.event_id + 1 WHERE a.event_type = 'signup'""")
def user_action(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "event_type", "value", "ts")
    answers = events.where("event_type = 'click'").withColumn("event_id", F.col("event_id") - 1).select(user.prompt_id("approve", "event_id").alias("uid"), F.struct(F.col("value").alias("approved")).alias("values"), "ts")
    return user.resolve(events.where("event_type = 'signup'"), answers, "approve", ["event_id"], "ts").select("event_id", F.col("user_values.approved").alias("approved"), "user_status")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_acctbal >= 0 AS success, CASE WHEN s_acctbal < 0 THEN 'balance' END AS error FROM supplier")
def notify_status(spark, sf_dir):
    def refuse_debtors(rows):
        return ["balance" if r["s_acctbal"] < 0 else None for r in rows]

    messages = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_acctbal", notify.render("Dear {{s_name}}").alias("subject"))
    return notify.send(messages, refuse_debtors)


@query("SELECT s_suppkey, 'Dear ' || s_name || ', no. ' || CAST(s_suppkey AS VARCHAR) || '!' AS body FROM supplier")
def notify_template(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", notify.render("Dear {{ s_name }}, no. {{s_suppkey}}!").alias("body"))
