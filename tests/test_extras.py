"""jq programs, schedules, user actions, notification sinks and the git source on small inputs."""

import datetime as dt
import subprocess

import pytest
from pyspark.sql import functions as F

from loomwright.functions import jq
from loomwright.plans import user
from loomwright.sources import gitfiles, notify
from loomwright.streaming import schedule

DOC = '{"a": {"b": [1, 2.5, "x", null]}, "c d": true, "rows": [{"n": 1, "t": "u"}, {"n": 3}], "f": false}'


@pytest.mark.parametrize("program, values", [
    (".a.b[0]", ["1"]), (".a.b[-2]", ['"x"']), (".a.b[]", ["1", "2.5", '"x"', "null"]), ('."c d"', ["true"]), (".missing", ["null"]), (".rows[].n", ["1", "3"]), (".rows | map(.n)", ["[1,3]"]), (".a.b | length", ["4"]),
    (".rows[] | select(.n > 1) | .n", ["3"]), ('.rows[] | select(.t == "u") | .n', ["1"]), (".f // 7", ["7"]), (".rows | first | .t", ['"u"']), (". | keys", ['["a","c d","f","rows"]']), (".a.b | last", ["null"]), ("length", ["4"]),
])
def test_jq(spark, program, values):
    df = spark.createDataFrame([(DOC,)], "j string")
    assert df.select(jq.query(F.col("j"), program)).first()[0] == values


def test_jq_refuses(spark):
    for program in ("reduce .[] as $x (0; . + $x)", ".a |", "select(.a)", ".a ?"):
        with pytest.raises(ValueError):
            jq.query(F.col("j"), program)
    assert spark.createDataFrame([("{oops",), (None,)], "j string").select(jq.query(F.col("j"), ".a")).collect() == [(None,), (None,)]


def test_schedule(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    cases = [("2024-01-01 05:59:00", 360, "09:00", "2024-01-01 06:00"), ("2024-01-01 06:00:00", 360, "00:00", "2024-01-01 12:00"), ("2024-01-03 10:00:00", 1440, "09:30", "2024-01-04 09:30"), ("2023-12-01 00:00:00", 60, "00:00", "2024-01-01 00:00")]
    for after, minutes, time, due in cases:
        got = spark.range(1).select(F.date_format(schedule.next_sync(at(after), at("2024-01-01 00:00:00"), minutes, time), "yyyy-MM-dd HH:mm")).first()[0]
        assert got == due, (after, got)
    with pytest.raises(ValueError):
        schedule.next_sync(at("2024-01-01"), at("2024-01-01"), 0)


def test_user_action(spark):
    asked = spark.createDataFrame([(1,), (2,)], "i long")
    answers = spark.createDataFrame([(1, "no", 1), (1, "yes", 2), (9, "?", 1)], "i long, values string, at int").select(user.prompt_id("ok", "i").alias("uid"), "values", "at")
    got = {r.i: (r.user_values, r.user_status) for r in user.resolve(asked, answers, "ok", ["i"], "at").collect()}
    assert got == {1: ("yes", "answered"), 2: (None, "waiting")}
    assert [r["values"] for r in user.unasked(asked, answers, "ok", ["i"]).collect()] == ["?"]


def test_a_failing_batch_of_messages(spark):
    def transport(rows):
        if any(r["id"] == "3" for r in rows):
            raise RuntimeError("down")
        return [None] * len(rows)

    got = {r.id: r.error for r in notify.send(spark.range(6).coalesce(1), transport, batch=2).collect()}
    assert got == {"0": None, "1": None, "2": "RuntimeError: down", "3": "RuntimeError: down", "4": None, "5": None}


def test_git_source(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@localhost", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.json").write_text("{}")
    (tmp_path / "y.txt").write_text("why")
    run("add", "-A")
    run("commit", "-qm", "one")
    got = {r.path: bytes(r.content) for r in gitfiles.read_git(spark, str(tmp_path)).collect()}
    assert got == {"d/x.json": b"{}", "y.txt": b"why"}
    assert [r.path for r in gitfiles.read_git(spark, str(tmp_path), paths=["d"]).collect()] == ["d/x.json"]
    with pytest.raises(Exception, match="(?i)nothere"):
        gitfiles.read_git(spark, str(tmp_path), "nothere").collect()


def test_jq_predicates(spark):
    df = spark.createDataFrame([(DOC,)], "j string")
    j = F.col("j")
    assert list(df.select(jq.exists(j, ".a"), jq.exists(j, ".z"), jq.equals(j, ".rows[0].t", "u"), jq.is_true(j, '."c d"'), jq.is_false(j, ".f"), jq.is_null(j, ".z"), jq.is_null(j, ".rows[] | select(.n > 9)"), jq.merge(F.lit('{"a":1,"b":2}'), F.lit('{"b":3}'))).first()) == [True, False, True, True, True, True, False, '{"a":1,"b":3}']


def test_pages_of_a_service(spark):
    from loomwright.plans.sqlservice import SqlService, param_names

    s = SqlService(spark, {"t": spark.range(25).toDF("i")})
    seen, token = [], ""
    while True:
        p = s.page("SELECT i FROM t WHERE i <> :x ORDER BY i DESC", {"x": 3}, 10, token)
        seen += [r.i for r in p.rows]
        assert (p.total_rows, p.total_pages) == (24, 3)
        if not p.next_token:
            break
        token = p.next_token
    assert seen == [i for i in range(24, -1, -1) if i != 3]
    with pytest.raises(ValueError, match="another query"):
        s.page("SELECT i FROM t", token=p.previous_token)
    with pytest.raises(Exception, match="(?i)parameter"):
        s.run("SELECT i FROM t WHERE i = :x")
    assert s.validate("SELECT i FROM t WHERE i = :x", types={"x": "INT64"}).valid and not s.validate("SELECT i FROM t WHERE i = :x", {"x": "a"}, {"x": "INT64"}).valid
    assert param_names("SELECT ':no', a::int, `:b`, :yes -- :never\n, :too /* :nor */") == ["yes", "too"]
    for q in ("INSERT INTO t VALUES (1)", "CREATE TABLE x AS SELECT 1", "SET a=b", "WITH a AS (SELECT 1 AS i) INSERT INTO t SELECT * FROM a"):
        assert s.validate(q).error, q
    assert s.models({"m2": "SELECT 'm1' AS m3 FROM m1", "m1": "SELECT i AS m2 FROM t"}) == ["m1", "m2"]


def test_uuid_pages_and_connections(spark):
    import uuid

    from loomwright.operators import paging

    ids = [f"018f3f5e-7c1a-7abc-8def-{k:012x}" for k in range(25)]
    df, token, seen = spark.createDataFrame([(i,) for i in ids], "id string"), "", []
    while True:
        p = paging.uuid7_page(df, "id", 10, token)
        seen += [r.id for r in p.rows]
        if not p.next_token:
            break
        token = p.next_token
    assert seen == ids[::-1] and uuid.UUID(ids[0]).version == 7
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 5) for i in range(20)], "i long, v long")
    for order in ([("v", False), ("i", False)], [("v", True), ("i", True)]):
        whole = [r.i for r in rows.orderBy(*paging.order_columns(order)).collect()]
        got, cursor = [], ""
        while True:
            c = paging.connection(rows, order, first=3, after=cursor)
            got += [r.i for _, r in c.edges]
            if not c.has_next:
                break
            cursor = c.end_cursor
        assert got == whole and c.total_count == 20
        got, cursor = [], ""
        while True:
            c = paging.connection(rows, order, last=3, before=cursor)
            got = [r.i for _, r in c.edges] + got
            if not c.has_previous:
                break
            cursor = c.start_cursor
        assert got == whole


def test_table_bytes_and_ranges(spark, sf, tmp_path):
    import os

    from loomwright.sources import readers

    r = readers.table_bytes({"orders": spark.read.parquet(f"{sf}/orders.parquet")}).first()
    assert (r.table_id, r.total_bytes) == ("orders", os.path.getsize(f"{sf}/orders.parquet")) and r.total_rows > 0
    (tmp_path / "b").write_bytes(b"0123456789")
    cut = lambda a, n: bytes(readers.blob_range(spark, str(tmp_path / "b"), a, n).first().data)
    assert [cut(2, 3), cut(8, 9), cut(20, 3), cut(4, -1), cut(0, 0)] == [b"234", b"89", b"", b"456789", b""]
    (tmp_path / "j").write_text('{"a":1}{"a":2} [3]\n"x"')
    assert [x.value for x in readers.json_values(spark, str(tmp_path / "j")).collect()] == ['{"a":1}', '{"a":2}', "[3]", '"x"']
    with pytest.raises(Exception, match="starts with"):
        readers.json_values(spark, str(tmp_path / "j"), array=True).collect()
    with pytest.raises(ValueError, match="no delimiter"):
        readers.blob_lines(spark, str(tmp_path), ";", form="json", array=True)


def test_text_scans_and_numbers(spark):
    from loomwright.functions import text

    one = lambda f, *v: [spark.range(1).select(f(F.lit(x)).alias("v")).first().v for x in v]
    assert one(lambda c: text.scan_value(c, "int8"), "101", "-1", "10000000", "2") == [5, -1, None, None]
    assert one(lambda c: text.scan_value(c, "int64"), "ff", "7fffffffffffffff", "8000000000000000", "zz") == [255, (1 << 63) - 1, None, None]
    assert one(lambda c: text.parse_number(c, "UINT64"), "18446744073709551615", "18446744073709551616", "-1", " 1") == [(1 << 64) - 1, None, None, None]
    assert one(lambda c: text.parse_number(c, "DOUBLE"), "1e3", ".5", "x", "inf") == [1000.0, 0.5, None, float("inf")]
    assert one(text.uri_valid, "https://h:80/p?q#f", "/only/path", "no spaces here") == [True, True, False]
    assert [tuple(x) for x in one(text.uri_parts, "s3://b/k/v", "/tmp/x")] == [("s3", "b", "/k/v", "", ""), ("file", "", "/tmp/x", "", "")]
    assert one(lambda c: text.add_enum(c, "KIND_UNSPECIFIED"), "A") == ["KIND_A"]


def test_pull(spark, tmp_path):
    from loomwright.streaming import streams

    def failing():
        raise OSError("down")

    with pytest.raises(OSError):
        streams.pull(spark, failing, str(tmp_path / "p"), continue_on_error=True)
    polls = iter([spark.range(1), None, OSError("down")])

    def fetch():
        x = next(polls)
        if isinstance(x, Exception):
            raise x
        return x

    with pytest.raises(OSError):
        streams.pull(spark, fetch, str(tmp_path / "q"), wait=lambda s: None)


def test_as_of_and_intervals(spark):
    import random

    from loomwright.operators import joins

    random.seed(4)
    left = [(i, random.choice("ab"), random.randrange(300)) for i in range(200)]
    right = [(random.choice("abc"), random.randrange(-50, 300), random.choice([None, 1.0, 2.0])) for _ in range(60)]
    right = list({(k, t): (k, t, v) for k, t, v in right}.values())
    got = joins.as_of(spark.createDataFrame(left, "i long, k string, t long"), spark.createDataFrame(right, "k string, at long, v double"), "k", "t", "at", 37, ["v"]).collect()
    want = {i: max(((a, True, v) for kk, a, v in right if kk == k and a <= t), key=lambda x: x[0], default=(0, False, None)) for i, k, t in left}
    assert len(got) == 200 and {r.i: r.v for r in got} == {i: w[2] for i, w in want.items()}
    spans = [(i, a, a + random.randrange(0, 90)) for i, a in enumerate(random.choices(range(300), k=40))]
    pairs = joins.in_interval(spark.createDataFrame(left, "i long, k string, t long"), spark.createDataFrame(spans, "s long, lo long, hi long"), "t", "lo", "hi", 25).select("i", "s").collect()
    assert sorted(map(tuple, pairs)) == sorted((i, s) for i, _, t in left for s, a, b in spans if a <= t < b)
