"""Unit tests of the engine: expected values of flows, vectors of functions, errors and edge cases."""

import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright import types
from loomwright.cel.compiler import cel
from loomwright.cel.parser import CelError, parse
from loomwright.functions import geo, text
from loomwright.functions.actions import Registry
from loomwright.operators import paging
from loomwright.operators.predicate import Edge, Relations
from loomwright.plans import flow
from loomwright.plans.sqlservice import SqlService
from loomwright.sources import readers, writers
from loomwright.storage import shared_path
from loomwright.streaming import streams


def value(spark, expr, **columns):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()] or [F.lit(1).alias("one")])
    return df.select(cel(df, expr).alias("v")).first().v


@pytest.mark.parametrize(
    "expr, want",
    [
        ("7 / 2", 3), ("-7 / 2", -3), ("-7 % 3", -1), ("7.0 / 2.0", 3.5), ("1.0 / 0.0 > 1e308", True), ("null == null", True), ("1 + 2 * 3 - 4", 3), ("!true || 1 < 2", True), ("'a' + 'b'", "ab"), ("[1, 2] + [3]", [1, 2, 3]),
        ("1 in [1, 2]", True), ("'k' in {'k': 1}", True), ("{'k': 5}['k']", 5), ("{'k': 5}.k", 5), ("has({'k': 5}.z)", False), ("[1, 2, 3][1]", 2), ("size('é🎉')", 2), ("size(b'abc')", 3), ("'abc'.matches('b.')", True),
        ("[1, 2, 3].map(x, x > 1, x * 2)", [4, 6]), ("[].all(x, x > 1)", True), ("[3, 1, 2].sort()", [1, 2, 3]), ("['bb', 'a'].sortBy(s, size(s))", ["a", "bb"]), ("[[1], [2, 3]].flatten()", [1, 2, 3]), ("[1, 2, 3, 4].slice(1, 3)", [2, 3]), ("lists.range(3)", [0, 1, 2]), ("lists.range(0)", []),
        ("int('42')", 42), ("int(1.9)", 1), ("double('1.5')", 1.5), ("string(7)", "7"), ("bool('true')", True), ("'tacocat'.lastIndexOf('a')", 5), ("'tacocat'.indexOf('x')", -1), ("'ÀB'.lowerAscii()", "Àb"), ("'a,b,c'.split(',', 2)", ["a", "b,c"]),
        ("['a', 'b'].join('-')", "a-b"), ("'hello hello'.replace('he', 'we', 1)", "wello hello"), ("'  x '.trim()", "x"), ("'%s is %d, %.2f, %x and %b'.format(['a', 5, 1.5, 255, 5])", "a is 5, 1.50, ff and 101"), ("strings.quote('a\"b\\n')", '"a\\"b\\n"'),
        ("url('https://u.org:80/p?a=1&b=2&a=3').getQuery()", {"a": ["1", "3"], "b": ["2"]}), ("url('https://u.org:80/p').getPort()", "80"), ("isURL('nope')", False), ("base64.encode(b'hi')", "aGk="), ("timestamp('2024-02-03T04:05:06Z').getMonth()", 1), ("timestamp('2024-02-03T23:05:06Z').getHours('Asia/Tokyo')", 8),
        ("duration('1h30m').getMinutes()", 90), ("(1 / 0 > 1) && false", False), ("true || [1][5] > 1", True), ("true ? 'a' : 'b'", "a"), ("0x1F", 31), ("{'a': 1}.map(k, k + '!')", ["a!"]), ("'a\\u00e9'", "aé"), ("r'\\d'", "\\d"),
    ],
)
def test_cel(spark, expr, want):
    assert value(spark, expr) == want


@pytest.mark.parametrize("expr", ["1 +", "1 + 1.0", "x", "'a' - 'b'", "nope(1)", "true && 1", "(1"])
def test_cel_compile_errors(spark, expr):
    with pytest.raises(CelError):
        value(spark, expr)


@pytest.mark.parametrize("expr", ["1 / (one - 1)", "[1][5]", "{'a': 1}.b", "int('x')", "9223372036854775807 + one", "1 / (one - 1) > 0 && true"])
def test_cel_runtime_errors(spark, expr):
    with pytest.raises(Exception):
        value(spark, expr, one=1)


def iterations(spark, *rows, schema):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, " + schema)


def out(spark, spec, *rows, schema="unused int"):
    return [r.asDict() for r in flow.run(spec, iterations(spark, *(rows or [(0,)]), schema=schema), ["seq"]).orderBy("seq").collect()]


def test_flow_golden_values(spark):
    from loomwright.catalogue import WIDE, chain

    assert out(spark, chain(10))[0]["result"] == 11
    assert out(spark, WIDE)[0]["result"] == 110
    lists = {"inputs": [{"id": "xs", "list": {"items": "int64", "default": [1, 2, 3, 4, 5]}}], "vars": [{"id": "big", "value": "= inputs.xs.filter(x, x > 2)"}, {"id": "two", "value": "= vars.big.map(x, x * 2)"}], "outputs": [{"id": "result", "value": "= vars.two[0] + vars.two[1] + vars.two[2]"}]}
    assert out(spark, lists)[0]["result"] == 24
    shared = {"inputs": [{"id": "s", "int64": {"default": 100}}], "vars": [{"id": f"x{k}", "value": f"= inputs.s * {k}"} for k in (2, 3, 4, 5)], "outputs": [{"id": "result", "value": "= vars.x2 + vars.x3 + vars.x4 + vars.x5"}]}
    assert out(spark, shared)[0]["result"] == 1400
    wide = {"inputs": [{"id": "base", "int64": {"default": 1}}], "vars": [{"id": f"b{b}s{s}", "value": f"= {'inputs.base + ' + str(b) if s == 0 else f'vars.b{b}s{s - 1} + 1'}"} for b in range(3) for s in range(10)], "outputs": [{"id": f"o{b}", "value": f"= vars.b{b}s9"} for b in range(3)]}
    assert [out(spark, wide)[0][f"o{b}"] for b in range(3)] == [10, 11, 12]


def test_flow_iterations_and_state(spark):
    squares = {"inputs": [{"id": "n", "int64": {}}], "outputs": [{"id": "r", "value": "= inputs.n * inputs.n"}, {"id": "done", "value": "= inputs.n == 5"}]}
    got = out(spark, squares, *[(i,) for i in range(6)], schema="n long")
    assert [r["r"] for r in got] == [0, 1, 4, 9, 16, 25] and [r["done"] for r in got] == [False] * 5 + [True]
    cached = {"inputs": [{"id": "n", "int64": {}}], "vars": [{"id": "c", "value": "= inputs.n + 100", "cache": True}], "outputs": [{"id": "a", "value": "= vars.c * 3"}, {"id": "p", "value": "= inputs.n.getPrev()"}]}
    assert [(r["a"], r["p"]) for r in out(spark, cached, (0,), (100,), schema="n long")] == [(300, None), (300, 0)]
    gate = {"inputs": [{"id": "n", "int64": {}}], "streams": [{"id": "s", "value": "= inputs.n", "start_if": "= inputs.n > 1", "stop_if": "= inputs.n == 4"}], "outputs": [{"id": "r", "value": "= streams.s"}]}
    assert [r["r"] for r in out(spark, gate, *[(i,) for i in (0, 2, 1, 4, 5)], schema="n long")] == [None, 2, 1, None, None]


def test_flow_errors(spark):
    ring = {"vars": [{"id": "a", "value": "= vars.b"}, {"id": "b", "value": "= vars.c"}, {"id": "c", "value": "= vars.a"}]}
    for spec, word in ((ring, "cycle"), ({"vars": [{"id": "a", "value": "= outputs.o"}], "outputs": [{"id": "o", "value": "= 1"}]}, "must not"), ({"vars": [{"id": "a", "value": "= vars.zz"}]}, "no node"), ({"vars": [{"id": "a", "value": 1}] * 2}, "two nodes")):
        with pytest.raises(flow.FlowError, match=word):
            flow.Flow(spec)
    with pytest.raises(Exception, match="cannot be null"):
        out(spark, {"inputs": [{"id": "n", "int64": {}}], "outputs": [{"id": "r", "value": "= inputs.n"}]})
    assert out(spark, {"inputs": [{"id": "n", "int64": {"nullable": True}}], "outputs": [{"id": "r", "value": "= inputs.n"}]})[0]["r"] == 0


def test_flow_graph_levels():
    f = flow.Flow({"vars": [{"id": "a", "value": 1}, {"id": "b", "value": "= vars.a"}, {"id": "c", "value": "= vars.a"}, {"id": "d", "value": "= vars.b + vars.c + vars.a"}]})
    assert [[k[1] for k in g] for g in f.levels()] == [["a"], ["b", "c"], ["d"]]
    assert (("vars", "a"), ("vars", "d")) not in f.reduced_edges() and len(f.reduced_edges()) == 4
    assert flow.Flow({}).levels() == []


def text_of(spark, f, s):
    return spark.createDataFrame([(s,)], "s string").select(f(F.col("s")).alias("v")).first().v


@pytest.mark.parametrize("f, s, want", [
    (text.slugify, "Super Cool, Inc.", "super-cool-inc"), (text.slugify, "FooBar@1.0.0", "foo-bar-1-0-0"), (text.slugify, "@#$%^&*()", ""), (text.slugify, "unix+tcp", "unix-tcp"), (lambda c: text.slugify(c, "_"), "Super Cool, Inc.", "super_cool_inc"),
    (text.pascal, "hello_world", "HelloWorld"), (text.pascal, "123number first", "123numberFirst"), (text.snake, "XMLHttpRequest", "xml_http_request"), (text.kebab, "OpenURL", "open-url"), (text.kebab, "ALLCAPS", "allcaps"), (text.name_parent, "users/jordan/connections/petstore", "users/jordan"),
    (text.name_short, "users/jordan", "jordan"), (text.int_from_text, "1234.123124", 1234), (text.fnv1a, "", "cbf29ce484222325"), (text.fnv1a, "a", "af63dc4c8601ec8c"), (text.fnv1a, "foobar", "85944171f73967e8"), (text.sanitize_field, "1a-b", "_1a_b"), (text.uri_scheme, "git+ssh://x", "git+ssh"),
    (text.trim_scheme, "https://x/y", "x/y"), (text.tidy, " a \n b ", "a b"),
])
def test_text_vectors(spark, f, s, want):
    assert text_of(spark, f, s) == want


def test_numbers_and_packages(spark):
    assert spark.range(1).select(text.int_from_float(F.lit(1.999)).alias("v")).first().v == 2
    p = text_of(spark, text.package_parts, "store@1.12.3")
    assert (p.name, p.major, p.minor, p.patch) == ("store", 1, 12, 3)


def test_geo(spark):
    g = spark.createDataFrame([('{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]},{"type":"LineString","coordinates":[[3,-4],[5.5,6]]}]}',), ('{"type":"MultiPolygon","coordinates":[[[[0,0],[2,0],[2,2],[0,0]]]]}',)], "g string")
    assert [list(r.b) for r in g.select(geo.bbox(geo.parse_geometry(F.col("g"))).alias("b")).collect()] == [[1, -4, 5.5, 6], [0, 0, 2, 2]]
    assert [list(r.b) for r in g.select(geo.bbox(geo.parse_geometry(geo.from_wkb(geo.to_wkb(F.col("g"))))).alias("b")).collect()] == [[1, -4, 5.5, 6], [0, 0, 2, 2]]
    assert spark.range(1).select(geo.geohash(F.lit(57.64911), F.lit(10.40744), 11).alias("h")).first().h == "u4pruydqqvj"
    n, h = spark.range(1).select(geo.geohash_uint64(F.lit(57.64911), F.lit(10.40744)), geo.geohash(F.lit(57.64911), F.lit(10.40744), 12)).first()
    digits = "".join(f"{geo.BASE32.index(c):05b}" for c in h)
    assert f"{int(n):064b}"[:60] == digits


def test_where_errors_and_edges(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "id long, name string"), spark.createDataFrame([(1,)], "a_id long")
    r = Relations({"a": a, "b": b}, {("a", "Bs"): Edge("b", "id", "a_id")})
    ids = lambda w: sorted(x.id for x in r.filter("a", w).collect())
    assert ids({}) == [1, 2] and ids({"hasBs": True}) == [1] and ids({"hasBs": False}) == [2] and ids({"nameIsNil": True}) == [2] and ids({"not": {"hasBs": True}}) == [2] and ids({"or": [{"hasBs": True}, {"nameIsNil": True}]}) == [1, 2] and ids({"or": []}) == []
    with pytest.raises(KeyError):
        r.filter("a", {"nope": 1})


def test_pages(spark):
    df = spark.range(25).select(F.col("id"), (F.col("id") % 3).alias("g"))
    seen, token = [], ""
    while True:
        p = paging.page(df, [("g", True), ("id", False)], 10, token)
        seen += [r.id for r in p.rows]
        if not p.has_next:
            break
        token = p.next_token
    assert seen == [r.id for r in df.orderBy(F.desc("g"), "id").collect()] and p.next_token == ""
    assert [paging.clamp(n) for n in (0, -3, 50, 1000)] == [10, 1, 50, 100]
    u = uuid.UUID("018f3f5e-7c1a-7abc-8def-0123456789ab")
    assert paging.decode_uuid7(paging.encode_uuid7(u)) == u
    with pytest.raises(ValueError):
        paging.encode_uuid7(uuid.UUID("018f3f5e-7c1a-4abc-8def-0123456789ab"))


def test_sql_service(spark):
    t = spark.createDataFrame([(1, 2.0)], "a long, b double")
    s = SqlService(spark, {"t": t}, {"t": ["a"]})
    assert [r.a for r in s.stream("SELECT a FROM t WHERE a = :x", {"x": 1})] == [1]
    assert not s.validate("SELECT nope FROM t").valid
    with pytest.raises(ValueError, match="cycle"):
        s.models({"m": "SELECT * FROM n", "n": "SELECT * FROM m"})


def test_json_schema(spark):
    schema = {"type": "object", "$defs": {"p": {"type": "object", "properties": {"x": {"type": "number"}}}}, "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 0}, "big": {"type": "integer", "minimum": 0, "maximum": 1 << 40}, "f": {"type": "number", "format": "float"}, "t": {"type": "string", "format": "date-time"}, "m": {"type": "object", "additionalProperties": {"type": "string"}}, "p": {"$ref": "#/$defs/p"}, "o": {"anyOf": [{"type": "null"}, {"type": "boolean"}]}, "l": {"type": "array", "items": {"type": "string"}}}}
    t = types.from_json_schema(schema)
    assert t["n"].dataType == T.LongType() and not t["n"].nullable and t["big"].dataType == T.DecimalType(20, 0) and t["f"].dataType == T.FloatType() and t["t"].dataType == T.TimestampType()
    assert t["m"].dataType == T.MapType(T.StringType(), T.StringType()) and t["p"].dataType["x"].dataType == T.DoubleType() and t["o"].dataType == T.BooleanType()
    plain = T.StructType([T.StructField("a", T.LongType(), False), T.StructField("b", T.ArrayType(T.StringType()), False), T.StructField("c", T.StructType([T.StructField("d", T.DoubleType())]))])
    assert types.from_json_schema(types.to_json_schema(plain)).simpleString() == plain.simpleString()
    assert types.find_native("BigInt") == "INT64"
    assert types.from_json_schema({"type": "integer", "x-own-format": "uint64", "format": "int32"}, extension="x-own-format") == T.DecimalType(20, 0)
    assert types.from_json_schema({"type": "integer", "x-vendor-format": "uint64", "format": "int32"}) == T.IntegerType()


def test_actions(spark):
    r = Registry()
    r.add("Half", "half", {"type": "integer", "maximum": 10}, {"type": "number"}, lambda c: c / 2)
    df = spark.createDataFrame([(4,), (40,)], "n int")
    assert [x.v for x in df.select(r.try_call("Half", F.col("n"), F.lit(-1.0)).alias("v")).collect()] == [2.0, -1.0]
    with pytest.raises(Exception, match="bad input"):
        df.select(r.call("actions/half", F.col("n"))).collect()
    with pytest.raises(KeyError):
        r.find("other")


def test_blobs_and_features(spark):
    import io
    import zipfile

    path = shared_path(spark, "blob")
    spark.createDataFrame([("a;b;;c",)], "value string").write.option("lineSep", ";").text(path)
    assert [r.value for r in readers.blob_lines(spark, path, ";").collect()] == ["a", "b", "", "c"]
    assert [r.token for r in readers.split_delimited(spark.createDataFrame([("x|y|",)], "s string"), "s", "|").collect()] == ["x", "y"]
    assert readers.blob_range(spark, path, 2, 3).collect()[0].data == b"b;;" and readers.list_blobs(spark, path, "part").count() >= 1
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("in.txt", "inside")
    writers.put_blob(spark, f"{path}-z/a.zip", z.getvalue())
    assert [(r.member, bytes(r.content)) for r in readers.read_zip(spark, f"{path}-z").collect()] == [("in.txt", b"inside")]
    with pytest.raises(Exception, match="a line of"):
        readers.blob_lines(spark, path, ";", max_size=0).collect()
    many = spark.range(25_000).coalesce(1).select(F.format_string('{"type":"Feature","geometry":{"type":"Point","coordinates":[%d,2]},"properties":{}}', "id").alias("value"))
    writers.write_feature_collection(many, f"{path}-many")
    assert spark.read.option("multiLine", True).json(f"{path}-many").select(F.size("features")).collect() == [(25_000,)]
    lines = spark.createDataFrame([('{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":{}}',)], "value string")
    writers.write_feature_collection(lines, f"{path}-fc")
    assert spark.read.option("multiLine", True).json(f"{path}-fc").select(F.size("features")).first()[0] == 1
    with pytest.raises(Exception, match="no Feature"):
        writers.checked_features(spark.createDataFrame([('{"type":"Point"}',)], "value string")).collect()
    with pytest.raises(ValueError, match="no features"):
        writers.write_feature_collection(lines.where("false"), f"{path}-none")


def test_stream_gate_agrees_with_batch(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    batch = streams.gate(events, ["user_id"], ["ts", "event_id"], F.col("value") > 100)
    path = shared_path(spark, "events")
    events.coalesce(1).sortWithinPartitions("ts", "event_id").write.parquet(path)
    live = streams.stateful_gate(streams.file_stream(spark, path).select("event_id", "user_id", "value"), "user_id", lambda p: p["value"] > 100, "event_id long, user_id long, value double")
    assert sorted(r.event_id for r in streams.drain(live, "gate").collect()) == sorted(r.event_id for r in batch.select("event_id").collect())


def test_latest_and_changes(spark):
    rows = spark.createDataFrame([(1, 1, "CREATE"), (1, 2, "DELETE"), (2, 1, "CREATE")], "k long, t long, action string")
    assert [r.k for r in streams.latest_by_key(rows, ["k"], ["t"], "action").collect()] == [2]
    assert streams.ticker_stream(spark).isStreaming
    with pytest.raises(Exception, match="unknown action"):
        streams.envelope(rows, F.lit("s"), F.lit("e"), F.lit("p"), F.lit("NOPE")).collect()


def test_parse_tree():
    assert parse("a.b(1)[2] ? -3 : {'k': [true]}")[0] == "if"
