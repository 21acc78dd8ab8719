"""More queries of the engine's own operators, and their oracle SQL: pages of SQL, blobs, streams, joins, geo, CEL and flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.catalogue import BOX_SQL, boxes, query, read, run_flow, service, with_cel
from loomwright.cel.compiler import cel
from loomwright.functions import geo, jq, text
from loomwright.functions.actions import aggregate
from loomwright.operators import joins, listing, paging, search
from loomwright.plans import flow
from loomwright.plans.sqlservice import DIALECT, SqlService
from loomwright.sources import notify, readers, writers
from loomwright.storage import shared_path
from loomwright.streaming import streams
from loomwright.types import find_native


def values(*rows: tuple) -> str:
    """SQL rows of literals."""
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


# SQL service

PRICED = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > {}"


@query(f"SELECT *, (SELECT count(*) FROM ({PRICED.format('100000.0')})) AS total_rows, (SELECT CAST(ceil(count(*) / 7.0) AS BIGINT) FROM ({PRICED.format('100000.0')})) AS total_pages FROM ({PRICED.format('100000.0')}) ORDER BY o_orderkey, o_totalprice LIMIT 7 OFFSET 7")
def sql_page(spark, sf_dir):
    """The second page, by the first one's token; the third page's token leads back to it."""
    s, ask = service(spark, sf_dir), (PRICED.format(":least"), {"least": "100000"}, 7)
    first = s.page(*ask, types={"least": "DOUBLE"})
    second = s.page(*ask, token=first.next_token, types={"least": "DOUBLE"})
    back = s.page(*ask, token=s.page(*ask, token=second.next_token, types={"least": "DOUBLE"}).previous_token, types={"least": "DOUBLE"})
    rows = [(*r, back.total_rows, back.total_pages) for r in back.rows if back.rows == second.rows]
    return spark.createDataFrame(rows, "o_orderkey long, o_totalprice double, total_rows long, total_pages long")


NESTED = "SELECT c_name, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS most FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name LIKE 'A%')"


@query(f"SELECT * FROM ({values(*[('customer', c) for c in ('c_custkey', 'c_name', 'c_nationkey')], ('nation', 'n_name'), ('nation', 'n_nationkey'), ('orders', 'o_custkey'), ('orders', 'o_totalprice'))}) t(table_id, \"column\")")
def sql_lineage_subquery(spark, sf_dir):
    found = service(spark, sf_dir).validate(NESTED).accessed
    return spark.createDataFrame([(t, c) for t in sorted(found) for c in sorted(found[t])], "table_id string, column string")


PROBES = [("scalar", "SELECT (SELECT max(c_acctbal) FROM customer) AS m", "column customer.c_acctbal is not accessible"), ("filter", "SELECT c_name FROM customer WHERE c_custkey > (SELECT min(c_acctbal) FROM customer)", "column customer.c_acctbal is not accessible"),
          ("wide", "SELECT c39 FROM wide", "column wide.c39 is not accessible"), ("unused", "SELECT c_name FROM (SELECT c_name, c_acctbal FROM customer)", "column customer.c_acctbal is not accessible"), ("command", "DROP VIEW customer", "only queries can be run"),
          ("self join", "SELECT a.c_name FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey", ""), ("with", "WITH t AS (SELECT c_name AS n FROM customer) SELECT n FROM t UNION ALL SELECT 'x'", "")]


@query(f"SELECT * FROM ({values(*[(n, not e, e) for n, _, e in PROBES], ('file', False, 'LogicalRelation is not a registered table'))}) t(name, valid, error)")
def sql_permission_probes(spark, sf_dir):
    customer = read(spark, sf_dir, "customer")
    wide = customer.select("c_custkey", *[F.col("c_acctbal").alias(f"c{i}") for i in range(40)])
    s = SqlService(spark, {"customer": customer, "wide": wide}, {"customer": ["c_custkey", "c_name"], "wide": ["c_custkey", "c0"]})
    asked = [(n, q) for n, q, _ in PROBES] + [("file", f"SELECT * FROM parquet.`{sf_dir}/orders.parquet`")]
    return spark.createDataFrame([(n, (v := s.validate(q)).valid, v.error) for n, q in asked], "name string, valid boolean, error string")


@query(f"SELECT * FROM ({values(('at', 'TIMESTAMP'), ('least', 'DOUBLE'), ('name', 'STRING'))}) t(name, kind)")
def sql_param_types(spark, sf_dir):
    q = "SELECT count(*) AS n FROM orders WHERE o_totalprice > :least AND o_orderdate > :at AND o_orderstatus <> ':not' /* :nor */ AND o_orderpriority = :name"
    kinds = service(spark, sf_dir).validate(q, {"least": 1.5}, {"at": "TIMESTAMP", "name": "STRING"}).param_types
    return spark.createDataFrame(sorted(kinds.items()), "name string, kind string")


@query(f"SELECT * FROM ({values((DIALECT, True, 2))}) t(dialect, same, n_fields)")
def sql_canonical(spark, sf_dir):
    """Two spellings of one query have one canonical plan."""
    s = service(spark, sf_dir)
    a, b = "SELECT c_custkey AS k, c_name FROM customer WHERE c_acctbal > 0", "select customer.c_custkey as k, c_name from customer where c_acctbal > 0"
    v = s.validate(a)
    return spark.createDataFrame([(v.dialect, s.canonical(a) == s.canonical(b), len(v.fields))], "dialect string, same boolean, n_fields int")


SETS_ALL = "SELECT k, count(*) AS n FROM ((SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) EXCEPT ALL (SELECT c_nationkey FROM customer WHERE c_acctbal < 0 INTERSECT ALL SELECT c_nationkey FROM customer WHERE c_custkey < 100)) t GROUP BY k"


@query(SETS_ALL)
def sql_setops_all(spark, sf_dir):
    return service(spark, sf_dir).run(SETS_ALL)


AGGREGATES = "SELECT l_returnflag, l_linestatus, count(DISTINCT l_suppkey) AS suppliers, min(l_shipdate) AS first_day, max(l_tax) AS most, round(avg(l_quantity), 6) AS mean, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY l_extendedprice), 6) AS middle, count(*) FILTER (WHERE l_discount > 0.05) AS cheap FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())"


@query(AGGREGATES)
def sql_aggregates(spark, sf_dir):
    return service(spark, sf_dir).run(AGGREGATES)


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o FROM orders GROUP BY 1")
def sql_pivot(spark, sf_dir):
    return service(spark, sf_dir).run("SELECT o_orderpriority, coalesce(f, 0) AS f, coalesce(o, 0) AS o FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o))")


# pages


@query("SELECT o_orderkey, p FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS p FROM orders) ORDER BY p NULLS LAST, o_orderkey LIMIT 100 OFFSET (SELECT count(*) - 60 FROM orders WHERE o_orderkey % 3 <> 0)")
def page_keyset_nulls(spark, sf_dir):
    """A page that starts among values and ends among nulls."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("p"))
    order = [("p", False), ("o_orderkey", False)]
    last = o.where("p IS NOT NULL").orderBy(F.desc("p"), F.desc("o_orderkey")).limit(61).orderBy("p", "o_orderkey").first()
    return paging.keyset(o, order, first=100, after=[last.p, last.o_orderkey])


@query("SELECT o_orderkey, p, (SELECT count(*) FROM orders) AS total_count, true AS has_previous, false AS has_next FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS p FROM orders) ORDER BY p DESC NULLS LAST, o_orderkey DESC LIMIT 5 OFFSET (SELECT count(*) - 5 FROM orders)")
def page_connection(spark, sf_dir):
    """The last page of edges, in page order, whose sort keys are null."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("p"))
    c = paging.connection(o, [("p", True), ("o_orderkey", True)], last=5)
    return spark.createDataFrame([(r.o_orderkey, r.p, c.total_count, c.has_previous, c.has_next) for _, r in c.edges], "o_orderkey long, p double, total_count long, has_previous boolean, has_next boolean")


@query(f"SELECT * FROM ({values(('clamp', '10 1 50 100'), ('find_native', 'INT64'), ('levels', 'a|b c|d'), ('uuid7', '018f3f5e-7c1a-7abc-8def-0123456789ab'))}) t(name, value)")
def small_codecs(spark, sf_dir):
    """Page sizes, native type names, levels of a graph and tokens of version 7 ids."""
    import uuid

    u = uuid.UUID("018f3f5e-7c1a-7abc-8def-0123456789ab")
    graph = flow.Flow({"vars": [{"id": "a", "value": 1}, {"id": "b", "value": "= vars.a"}, {"id": "c", "value": "= vars.a"}, {"id": "d", "value": "= vars.b + vars.c"}]})
    rows = [("clamp", " ".join(str(paging.clamp(n)) for n in (0, -3, 50, 1000))), ("find_native", find_native("BigInt")), ("levels", "|".join(" ".join(k[1] for k in g) for g in graph.levels())), ("uuid7", str(paging.decode_uuid7(paging.encode_uuid7(u))))]
    return spark.createDataFrame(rows, "name string, value string")


# blobs and files


@query(f"SELECT * FROM ({values(('x/a', 1), ('y/a', 2), ('y/b', 3), ('y/c/d', 4))}) t(key, length)")
def blob_listing(spark, sf_dir):
    """All keys below a root, in pages of two; equal names in different folders are different keys."""
    root = shared_path(spark, "blobs")
    for k, n in (("x/a", 1), ("y/a", 2), ("y/b", 3), ("y/c/d", 4)):
        writers.put_blob(spark, f"{root}/{k}", b"#" * n)
    first = readers.list_blobs(spark, root, size=2).collect()
    rows = first + readers.list_blobs(spark, root, size=2, after=first[-1].key).collect()
    return spark.createDataFrame([(r.key, r.length) for r in rows], "key string, length long")


@query(f"SELECT * FROM ({values(('new', 'written'), ('new again', 'FileExistsError'), ('other tag', 'ValueError'), ('its tag', 'written'), ('tag not wanted', 'ValueError'), ('copy', 'ccc'), ('copy again', 'FileExistsError'), ('range', 'c'), ('delete', 'true'))}) t(step, outcome)")
def blob_preconditions(spark, sf_dir):
    root = shared_path(spark, "blob")
    a, b = f"{root}/a", f"{root}/b"

    def tried(f):
        try:
            return f() or "written"
        except (FileExistsError, ValueError) as e:
            return type(e).__name__

    tag = []
    steps = [
        ("new", lambda: tag.append(writers.put_blob(spark, a, b"aa", if_not_exist=True)["etag"])), ("new again", lambda: writers.put_blob(spark, a, b"b", if_not_exist=True) and ""), ("other tag", lambda: writers.put_blob(spark, a, b"b", if_match="nope") and ""),
        ("its tag", lambda: writers.put_blob(spark, a, b"ccc", if_match=tag[0]) and ""), ("tag not wanted", lambda: writers.put_blob(spark, a, b"d", if_none_match=writers.etag_of(spark, a)) and ""),
        ("copy", lambda: writers.copy_blob(spark, a, b) or bytes(readers.blob_range(spark, b, 0, 99).first().data).decode()), ("copy again", lambda: writers.copy_blob(spark, a, b)), ("range", lambda: bytes(readers.blob_range(spark, b, 2, 9).first().data).decode()), ("delete", lambda: str(writers.delete_blob(spark, b)).lower()),
    ]
    return spark.createDataFrame([(n, tried(f)) for n, f in steps], "step string, outcome string")


@query(f"SELECT * FROM ({values(('d/in.txt', 6), ('top.txt', 3))}) t(member, size)")
def blob_zip(spark, sf_dir):
    import io
    import zipfile

    z, path = io.BytesIO(), f"{shared_path(spark, 'zip')}/a.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("d/in.txt", "inside")
        f.writestr("top.txt", "top")
    writers.put_blob(spark, path, z.getvalue())
    return readers.read_zip(spark, path).select("member", "size")


@query("SELECT event_id, event_type FROM events")
def json_stream_values(spark, sf_dir):
    """JSON values one after the other on one line of each file."""
    path = shared_path(spark, "values")
    read(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "event_type")).alias("value")).write.option("lineSep", " ").text(path)
    return readers.json_values(spark, path).select(F.from_json("value", "event_id long, event_type string").alias("v")).select("v.*")


@query("SELECT event_id, event_type FROM events")
def json_stream_array(spark, sf_dir):
    path = shared_path(spark, "array")
    rows = read(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "event_type")).alias("j")).withColumn("p", F.spark_partition_id())
    rows.groupBy("p").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ", "), F.lit("]")).alias("value")).select("value").write.text(path)
    return readers.json_values(spark, path, array=True).select(F.from_json("value", "event_id long, event_type string").alias("v")).select("v.*")


@query("SELECT n_nationkey, n_name FROM nation")
def yaml_stream(spark, sf_dir):
    path = shared_path(spark, "yaml")
    read(spark, sf_dir, "nation").select(F.format_string("n_nationkey: %d\nn_name: '%s'", "n_nationkey", "n_name").alias("value")).write.option("lineSep", "\n---\n").text(path)
    return readers.yaml_values(spark, path).select(F.from_json("value", "n_nationkey int, n_name string").alias("v")).select("v.*")


@query("SELECT c_custkey, c_custkey % 4 = 0 AS deleted FROM customer")
def soft_deleted(spark, sf_dir):
    c = writers.soft_delete(read(spark, sf_dir, "customer"), F.col("c_custkey") % 4 == 0, F.lit("2024-01-01").cast("timestamp"))
    return c.select("c_custkey", F.col("deleted_at").isNotNull().alias("deleted"))


@query("SELECT n_nationkey, [n_name, 'x'] AS names, n_name AS in_map FROM nation")
def codec_json(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    stored = n.select("n_nationkey", writers.to_text(F.array("n_name", F.lit("x"))).alias("l"), writers.to_text(F.create_map(F.lit("k"), F.col("n_name"))).alias("m"))
    return stored.select("n_nationkey", writers.from_text(F.col("l"), "array<string>").alias("names"), writers.from_text(F.col("m"), "map<string,string>")["k"].alias("in_map"))


# geo


@query(f"SELECT nullif(s_suppkey, 0) AS s_suppkey, x, y FROM {BOX_SQL}")
def feature_collections(spark, sf_dir):
    """Features written as collections and read back; a numeric id of 0 is none."""
    path = shared_path(spark, "features")
    point = F.format_string('{"type":"Point","coordinates":[%s,%s]}', F.col("x").cast("string"), F.col("y").cast("string"))
    lines = boxes(spark, sf_dir).select(geo.feature(point, F.struct(F.lit('a"b').alias("n")), F.col("s_suppkey")).alias("value"))
    writers.write_feature_collection(lines, path)
    found = spark.read.text(path, wholetext=True).select(F.explode(geo.collection_features(F.col("value"))).alias("f")).select(geo.parse_feature(F.col("f")).alias("f"))
    box = geo.bbox(geo.parse_geometry(F.col("f.geometry")))
    return found.select(F.col("f.id_number").alias("s_suppkey"), box[0].alias("x"), box[1].alias("y"))


@query(f"""SELECT s_suppkey, x >= -90 AND y >= -45 AND x + 2 <= 90 AND y + 2 <= 45 AS inside, x <= -10 AND y <= -10 AND x + 2 >= -9 AND y + 2 >= -9 AS holds, x + 1 >= -90 AND x + 1 <= 90 AND y + 1 >= -45 AND y + 1 <= 45 AS centre,
    abs(x) / 100.5 + abs(y) / 50.25 < 1 AND abs(x + 2) / 100.5 + abs(y) / 50.25 < 1 AND abs(x) / 100.5 + abs(y + 2) / 50.25 < 1 AND abs(x + 2) / 100.5 + abs(y + 2) / 50.25 < 1 AS in_ring FROM {BOX_SQL}""")
def geo_bounds(spark, sf_dir):
    g = geo.parse_geometry(F.col("g"))
    ring = [(100.5, 0.0), (0.0, 50.25), (-100.5, 0.0), (0.0, -50.25)]
    return boxes(spark, sf_dir).select("s_suppkey", geo.in_bounds(g, "WITHIN", -90, -45, 90, 45).alias("inside"), geo.in_bounds(g, "COVERS", -10, -10, -9, -9).alias("holds"), geo.in_bounds(g, "WITHIN", -90, -45, 90, 45, True).alias("centre"), geo.within_ring(g, ring).alias("in_ring"))


@query(f"SELECT 's' || s_suppkey AS id, x, 's\"' || s_suppkey AS name FROM {BOX_SQL} WHERE x <= 60 AND x + 2 >= -60 AND y <= 30 AND y + 2 >= -30")
def geo_scan(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumns({"id": F.concat(F.lit("s"), "s_suppkey"), "name": F.concat(F.lit('s"'), "s_suppkey")})
    found = geo.scan(b, "g", ["name"], ("INTERSECTS", -60, -30, 60, 30), "id").select(geo.parse_feature(F.col("value")).alias("f"))
    return found.select(F.col("f.id_text").alias("id"), geo.bbox(geo.parse_geometry(F.col("f.geometry")))[0].alias("x"), jq.value(F.col("f.properties"), ".name").alias("name")).withColumn("name", F.from_json(F.concat(F.lit('{"n":'), "name", F.lit("}")), "n string")["n"])


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN p_partkey END AS id_number, CASE p_partkey % 3 WHEN 0 THEN 'a\"' || p_partkey || '\\' END AS id_text FROM part")
def geo_feature_ids(spark, sf_dir):
    ident = F.when(F.col("p_partkey") % 3 == 1, F.col("p_partkey").cast("string")).when(F.col("p_partkey") % 3 == 2, "0").otherwise(F.concat(F.lit('a"'), F.col("p_partkey").cast("string"), F.lit("\\")))
    f = geo.parse_feature(geo.feature(F.lit(None).cast("string"), F.struct(F.lit(1).alias("one")), ident))
    return read(spark, sf_dir, "part").select("p_partkey", f["id_number"].alias("id_number"), f["id_text"].alias("id_text"))


# functions


@query("SELECT p_partkey, CASE WHEN p_partkey < 128 THEN p_partkey END AS binary, CASE WHEN p_partkey < 32768 THEN p_partkey END AS octal, p_partkey * 1000003 AS hex, -p_partkey AS decimal, p_partkey % 2 = 0 AS flag FROM part")
def text_scan(spark, sf_dir):
    k = F.col("p_partkey")
    written = {"binary": (F.conv(k.cast("string"), 10, 2), "int8"), "octal": (F.conv(k.cast("string"), 10, 8), "int16"), "hex": (F.lower(F.hex(k * 1000003)), "int64"), "decimal": (F.concat((-k).cast("string"), F.lit(" left")), "int"), "flag": ((k % 2 == 0).cast("string"), "bool")}
    return read(spark, sf_dir, "part").select("p_partkey", *[text.scan_value(s, kind).alias(n) for n, (s, kind) in written.items()])


@query("SELECT event_id, CASE WHEN event_id * 50000000 < 2147483648 THEN CAST(event_id * 50000000 AS INTEGER) END AS i32, CASE WHEN event_id * 50000000 < 4294967296 THEN event_id * 50000000 END AS u32, -event_id AS i64, CAST(NULL AS BIGINT) AS bad, event_id / 2.0 AS d, printf('%.6f', value) AS shown FROM events")
def text_numbers(spark, sf_dir):
    big, k = (F.col("event_id") * 50000000).cast("string"), F.col("event_id")
    return read(spark, sf_dir, "events").select("event_id", text.parse_number(big, "INT32").alias("i32"), text.parse_number(big, "UINT32").alias("u32"), text.parse_number((-k).cast("string"), "INT64").alias("i64"), text.parse_number(F.concat(k.cast("string"), F.lit("x")), "INT64").alias("bad"), text.parse_number((k / 2).cast("string"), "DOUBLE").alias("d"), text.any_text(F.col("value"), T.DoubleType()).alias("shown"))


@query("""SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'no duration' WHEN event_id % 10 = 1 THEN 'duration must be greater than zero' END AS positive,
    CASE WHEN event_id % 10 = 0 THEN 'no duration' WHEN event_id % 10 < 3 THEN 'duration must be greater than: 2m' WHEN event_id % 10 > 5 THEN 'duration must be less than: 4m' END AS ranged FROM events""")
def duration_valid(spark, sf_dir):
    k = F.col("event_id") % 10
    d = F.when(k == 0, "soon").otherwise(F.concat((k - 1).cast("string"), F.lit("m")))
    return read(spark, sf_dir, "events").select("event_id", text.duration_error(d).alias("positive"), text.duration_error(d, "2m", "4m").alias("ranged"))


@query("""SELECT event_id, CAST((event_id % 2 > 0)::INT + (event_id % 3 > 0)::INT + (event_id % 5 > 0)::INT AS BIGINT) AS n, list_filter([event_id % 2, event_id % 3, event_id % 5], lambda x: x <> 2) AS without, event_type AS last_key, user_id AS found,
    CAST(2 - (event_id % 3 = 0)::INT AS INTEGER) AS tried FROM events""")
def collections(spark, sf_dir):
    xs = F.array(*[F.col("event_id") % n for n in (2, 3, 5)])
    ordered = F.array(F.struct(F.lit("user").alias("key"), F.col("user_id").alias("value")), F.struct(F.col("event_type").alias("key"), F.col("event_id").alias("value")))
    tried = text.collected(F.array(F.lit(6).cast("long"), F.col("event_id") % 3), lambda x: F.try_divide(F.lit(6), x))
    return read(spark, sf_dir, "events").select("event_id", text.count_where(xs, lambda x: x > 0).alias("n"), text.without(xs, F.array(F.lit(2).cast("long"))).alias("without"), text.entry(ordered, -1)["key"].alias("last_key"), text.find_entry(ordered, lambda k, v: k == "user")["value"].alias("found"), F.size(tried["values"]).alias("tried"))


@query("SELECT event_id, event_type AS a, list_sort([event_type, 'k']) AS keys, 1 AS n_left FROM events")
def map_functions(spark, sf_dir):
    m = F.create_map(F.col("event_type"), F.lit(1), F.lit("k"), F.lit(2))
    pairs = F.map_entries(m)
    return read(spark, sf_dir, "events").select("event_id", text.entry_keys(text.popped(pairs)["rest"])[0].alias("a"), text.map_to_list(m, lambda k, v: k).alias("keys"), F.size(text.map_where(m, lambda k, v: v > 1)).alias("n_left"))


@query(r"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '://(.*)$', 1) AS rest, true AS valid FROM pages")
def uri_functions(spark, sf_dir):
    u, p = F.col("url"), text.uri_parts(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", text.uri_scheme(u).alias("scheme"), p["host"].alias("host"), p["path"].alias("path"), text.trim_scheme(u).alias("rest"), text.uri_valid(u).alias("valid"))


@query("SELECT p_partkey, regexp_extract(p_brand, '([A-Za-z]+)#?([0-9]*)', 1) AS word, regexp_extract(p_brand, '([A-Za-z]+)#?([0-9]*)', 2) AS digits FROM part")
def text_named_groups(spark, sf_dir):
    g = text.regex_groups(F.col("p_brand"), r"(?P<word>[A-Za-z]+)#?(?P<digits>[0-9]*)")
    return read(spark, sf_dir, "part").select("p_partkey", g["word"].alias("word"), g["digits"].alias("digits"))


@query("SELECT p_partkey, true AS same, false AS other FROM part")
def hash_canonical(spark, sf_dir):
    """Objects with their keys in another order have one hash, others have not."""
    a, b = F.struct("p_name", "p_size"), F.struct("p_size", "p_name")
    return read(spark, sf_dir, "part").select("p_partkey", (text.canonical_hash(a) == text.canonical_hash(b)).alias("same"), (text.canonical_hash(a) == text.canonical_hash(F.struct("p_name"))).alias("other"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) IS NOT NULL AS has_k, false AS has_z, coalesce(CAST(json_extract(props, '$.k') AS BIGINT) = 7, false) AS is_7, true AS z_is_null, CAST(json_extract(props, '$.k') AS BIGINT) > 50 AS large, '{\"k\":1,\"z\":true}' AS merged FROM events")
def jq_predicates(spark, sf_dir):
    p = F.col("props")
    merged = jq.merge(p, F.lit('{"z": true, "k": 1}'))
    return read(spark, sf_dir, "events").select("event_id", jq.exists(p, ".k").alias("has_k"), jq.exists(p, ".z").alias("has_z"), jq.equals(p, ".k", 7).alias("is_7"), jq.is_null(p, ".z").alias("z_is_null"), jq.exists(p, "select(.k > 50)").alias("large"), merged.alias("merged"))


# CEL, filters and rules

REGIONS = {"0": "REGION_UNSPECIFIED", "1": "REGION_AMERICA", "2": "REGION_ASIA"}


@query("SELECT n_nationkey, ['REGION_UNSPECIFIED', 'REGION_AMERICA', 'REGION_ASIA', '', ''][n_regionkey + 1] AS name, ['UNSPECIFIED', 'AMERICA', 'ASIA', '', ''][n_regionkey + 1] AS short FROM nation")
def cel_enum_name(spark, sf_dir):
    n = read(spark, sf_dir, "nation").withMetadata("n_regionkey", {"enum": REGIONS})
    return with_cel(n, ["n_nationkey"], name="enumName(n_regionkey)", short="enumName(n_regionkey, true)")


@query("""SELECT event_id, NOT (event_id % 2 = 0) AS negated, regexp_matches(event_type, '^c.*k$') AS matched, [event_type || '!'] AS made, event_type || '-' || event_type AS joined, [1, event_id] AS lists, 'int list string double' AS types, CAST(len(event_type) AS BIGINT) AS last_dash,
    true AS present, false AS absent, [1, 2, 3] AS flat FROM events""")
def cel_more(spark, sf_dir):
    return with_cel(read(spark, sf_dir, "events"), ["event_id"], negated="!(event_id % 2 == 0)", matched="event_type.matches('^c.*k$')", made="{event_type: 1}.map(k, k + '!')", joined="string(bytes(event_type) + b'-' + bytes(event_type))", lists="[1] + [event_id]", types="type(event_id) + ' ' + type([1]) + ' ' + type('') + ' ' + type(value)", last_dash="(event_type + '-' + event_type + '-').lastIndexOf('-', size(event_type) * 2)", present="has({'k': event_id}.k)", absent="has({'k': event_id}.z)", flat="[[[1]], [[2], [3]]].flatten(2)")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND value > 50 AND user_id % 2 = 1")
def list_filter(spark, sf_dir):
    """A filter on fields and labels; rows without the label don't match."""
    e = read(spark, sf_dir, "events").withColumns({"display_name": F.col("event_type"), "labels": F.when(F.col("user_id") % 2 == 1, F.create_map(F.lit("team"), F.lit("odd"))).otherwise(F.create_map(F.lit("other"), F.lit("x"))), "disabled": F.col("value") <= 50})
    return listing.filtered(e, "display_name == 'click' && labels.team == 'odd' && !disabled").select("event_id")


@query("SELECT event_id, list_filter([CASE WHEN NOT value > 10 THEN 'value' END, CASE WHEN event_type = 'error' THEN 'kind' END], lambda x: x IS NOT NULL) AS broken FROM events")
def message_rules(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    found = listing.violations(e, [("value", "too small", "value > 10.0"), ("kind", "", "event_type == 'error' ? 'an error: ' + event_type : ''")])
    return e.select("event_id", F.transform(found, lambda b: b["id"]).alias("broken"))


# flows


@query("SELECT event_id, max(CASE WHEN value > 150 THEN 1 ELSE 0 END) OVER w = 1 AS ended, CASE WHEN max(CASE WHEN value > 150 THEN 1 ELSE 0 END) OVER w = 0 THEN value END AS result FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def flow_eof(spark, sf_dir):
    spec = {"inputs": [{"id": "v", "double": {}}], "streams": [{"id": "s", "value": "= inputs.v", "stop_if": "= inputs.v > 150.0"}], "outputs": [{"id": "ended", "value": "= isEOF(streams.s)"}, {"id": "result", "value": "= streams.s"}]}
    return run_flow(spark, sf_dir, spec, {"v": "value"})


@query("SELECT event_id, user_id, event_type = 'error' AS done FROM events QUALIFY coalesce(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0")
def flow_until_done(spark, sf_dir):
    spec = {"inputs": [{"id": "kind", "string": {}}, {"id": "event_id", "int64": {}}], "vars": [{"id": "d", "switch": {"value": "= inputs.kind", "cases": [{"value": "error", "return": "= 'failed'"}]}}], "outputs": [{"id": "done", "value": "= vars.d"}, {"id": "event_id", "value": "= inputs.event_id"}]}
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("kind"))
    out = flow.run(spec, e, ["ts", "event_id"], ["user_id"]).toDF("user_id", "ts", "seq", "done", "event_id")
    return flow.until_done(out, "done", ["ts", "seq"], ["user_id"]).select("event_id", "user_id", F.col("done").isNotNull().alias("done"))


@query("SELECT event_id, user_id * 2 + 1 AS result FROM events")
def flow_response(spark, sf_dir):
    """A call's answer, and the projection that replaces it."""
    spec = {"inputs": [{"id": "n", "int64": {}}], "actions": [{"id": "a", "call": "twice", "request": "= inputs.n", "response": "= response.twice + 1"}], "outputs": [{"id": "result", "value": "= actions.a"}]}
    twice = lambda v: (F.struct((v.col * 2).alias("twice")), T.StructType([T.StructField("twice", T.LongType())]))
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("user_id").alias("n"))
    return flow.run(spec, e, ["ts", "event_id"], ["user_id"], {"twice": twice}).select("event_id", "result")


# joins and aggregates


@query("SELECT a.event_id, b.value AS price FROM (SELECT * FROM events WHERE event_type <> 'view') a ASOF LEFT JOIN (SELECT user_id, epoch_us(ts) AS t, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) b ON a.user_id = b.user_id AND epoch_us(a.ts) >= b.t")
def join_as_of(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    views = e.where("event_type = 'view'").groupBy("user_id", "t").agg(F.max("value").alias("price"))
    return joins.as_of(e.where("event_type <> 'view'").select("event_id", "user_id", "t"), views, "user_id", "t", "t", 86_400_000_000, ["price"]).select("event_id", "price")


@query("SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_totalprice >= c_acctbal * 20 AND o_totalprice < c_acctbal * 20 + 500 WHERE c_custkey < 400")
def join_range(spark, sf_dir):
    spans = read(spark, sf_dir, "customer").where("c_custkey < 400").select("c_custkey", (F.col("c_acctbal") * 20).alias("low"), (F.col("c_acctbal") * 20 + 500).alias("high"))
    return joins.in_interval(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), spans, "o_totalprice", "low", "high", 500.0).select("o_orderkey", "c_custkey")


@query("SELECT c_nationkey, round(exp(avg(ln(abs(c_acctbal) + 1))), 6) AS mean FROM customer GROUP BY 1")
def udf_aggregate(spark, sf_dir):
    def geometric(values):
        import numpy as np

        return float(np.exp(np.log(values.abs() + 1).mean()))

    return read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(aggregate(geometric, "double")("c_acctbal"), 6).alias("mean"))


@query("SELECT c_nationkey, CAST(count(*) FILTER (c_acctbal < 0) AS INTEGER) AS n, min(c_custkey) FILTER (c_acctbal < 0) AS first FROM customer GROUP BY 1")
def batch_failures(spark, sf_dir):
    """The errors of each batch by the place of the request."""
    c = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(text.failure_map(F.col("c_custkey"), F.when(F.col("c_acctbal") < 0, "balance")).alias("m"))
    return c.select("c_nationkey", F.size("m").alias("n"), F.array_min(F.map_keys("m")).alias("first"))


@query("""WITH d AS (SELECT * FROM documents WHERE lang = 'en'), w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS word FROM d), t AS (SELECT doc_id, word, count(*) AS tf FROM w WHERE word IN ('the', 'and') GROUP BY 1, 2), f AS (SELECT word, count(*) AS df FROM t GROUP BY 1)
SELECT doc_id, round(sum(tf * ln(1 + (SELECT count(*) FROM d) / df)), 6) AS score, (SELECT count(DISTINCT doc_id) FROM t) AS total FROM t JOIN f USING (word) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 5 OFFSET 5""")
def search_filtered(spark, sf_dir):
    docs, en = read(spark, sf_dir, "documents"), F.col("lang") == "en"
    total = search.total_matches(docs, "doc_id", "text", "the AND", en)
    return search.lexical(docs, "doc_id", "text", "the AND", 5, 5, en).withColumn("total", F.lit(total).cast("long"))


# streams


@query("""SELECT strftime(w, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS w, event_type FROM events) GROUP BY 1, 2""")
def stream_sliding_window(spark, sf_dir):
    e = streams.file_stream(spark, f"{sf_dir}/events.parquet")
    out = streams.drain_complete(streams.windowed_counts(e, "ts", "24 hours", "event_type", slide="12 hours"), "sliding")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
    SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) + 21600000000 AS ended, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    e = streams.file_stream(spark, f"{sf_dir}/events.parquet")
    out = streams.drain_complete(streams.session_counts(e, "ts", "6 hours", "user_id"), "sessions")
    return out.select("user_id", F.unix_micros("session_start").alias("started"), F.unix_micros("session_end").alias("ended"), "n")


@query("SELECT a.event_id AS click, b.event_id AS bought FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 DAY WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def stream_interval_join(spark, sf_dir):
    side = lambda kind, name, at: streams.file_stream(spark, f"{sf_dir}/events.parquet").where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(name), F.col("ts").alias(at))
    return streams.drain(streams.interval_join(side("click", "click", "clicked_at"), side("purchase", "bought", "bought_at"), "user_id", "clicked_at", "bought_at", "2 days", "400 days").select("click", "bought"), "pairs")


@query(f"SELECT * FROM ({values((1, 'UPDATE'), (2, 'UPDATE'), (4, 'CREATE'), (5, 'DELETE'))}) t(id, action)")
def change_feed_nulls(spark, sf_dir):
    """A value that moves to another column, or becomes null, is a change; a null that stays is none."""
    before = spark.createDataFrame([(1, "x", None), (2, "x", "y"), (3, None, "z"), (5, None, None)], "id int, a string, b string")
    after = spark.createDataFrame([(1, None, "x"), (2, "x", None), (3, None, "z"), (4, None, None)], "id int, a string, b string")
    return streams.change_feed(before, after, "id")


@query("SELECT event_id FROM events WHERE event_id < 30 AND NOT (event_id >= 10 AND event_id < 20)")
def pull_source(spark, sf_dir):
    """Polls of ten events each: the second fails and is passed over, the fourth gives nothing, the fifth is the end."""
    path, polls = shared_path(spark, "pulled"), iter(range(5))

    def fetch():
        n = next(polls)
        if n == 1:
            raise OSError("down")
        if n == 4:
            raise EOFError
        return None if n == 3 else read(spark, sf_dir, "events").where(F.col("event_id").between(n * 10, n * 10 + 9)).select("event_id")

    streams.pull(spark, fetch, path, continue_on_error=True, wait=lambda s: None)
    return spark.read.schema("event_id long").json(path)
