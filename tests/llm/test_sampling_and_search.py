"""Mixing and nearest neighbours against brute force."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import mixing, vptree


def water(sizes: dict, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, free, rest = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2 * sizes[s]
            rest -= target[s]
        free -= over


def test_mix_targets_and_takes(spark, sf):
    docs = spark.read.parquet(sf + "/documents.parquet").select("doc_id", "text", "source")
    odd = spark.createDataFrame([(-1, None, "a"), (-2, "", "a"), (-3, "some words here", None), (-3, "some words here", None), (None, "no id", "zz")], "doc_id long, text string, source string")
    docs = docs.union(odd)
    rows = mixing.plan(docs).collect()
    again = mixing.plan(docs.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == docs.count()
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.size * len(r.shards)
        most[r.source] = max(most[r.source], r.size)
        assert r.size == 0 or len(r.shards) <= 2
    want = water(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] / 2 + 1
    mixed = mixing.mix(docs.withColumn("mix_place", F.lit("clash")), shard_words=5000)
    assert mixed.count() == sum(len(r.shards) for r in rows) and mixed.columns == ["doc_id", "text", "source", "mix_shard", "mix_place"]


def test_splitting_tree_is_exact_and_disjoint():
    counts = np.array([7, 0, 100, 33])
    got = defaultdict(list)
    for at, n, node, begin, c in mixing.splitting_tree(counts, 11):
        assert n == 1
        for k in range(4):
            got[k] += range(begin[k], begin[k] + c[k])
    assert all(sorted(got[k]) == list(range(counts[k])) for k in range(4))
    whole = {a: c.tolist() for a, _, _, _, c in mixing.splitting_tree(counts, 11)}
    parts = {a: c.tolist() for s in mixing.splitting_tree(counts, 11, depth=2) for a, _, _, _, c in mixing.splitting_tree(s[4], s[1], s[2], s[0], s[3])}
    assert whole == parts and max(map(sum, whole.values())) - min(map(sum, whole.values())) <= 1


def test_urn_with_given_sizes():
    """Each shard gets its size, each colour's draws go to shards once, and the shares are hypergeometric on average."""
    counts, sizes = np.array([40, 0, 100, 1]), np.array([30, 1, 0, 60, 50])
    share = 0
    for seed in range(300):
        got, size = defaultdict(list), np.zeros(5, int)
        for at, colours, begin, c in mixing.dealt_out(counts, sizes, (seed,)):
            size[at] += c.sum()
            share += int(c[colours == 0].sum()) if at == 0 else 0
            for k, b, n in zip(colours, begin, c):
                got[k] += range(b, b + n)
        assert (size == sizes).all() and all(sorted(got[k]) == list(range(counts[k])) for k in got)
    assert abs(share / 300 - 30 * 40 / 141) < 0.5


def test_mix_of_repeated_rows_and_clashing_names(spark):
    rows = [(1, "a b c", "s", k, "x") for k in range(500)] + [(k, f"text {k}", "t", k, "y") for k in range(100)] + [(None, None, None, 0, "z")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _turn int, _x string").repartition(3)
    plan = mixing.plan(docs, shard_words=300).collect()
    mixed = mixing.mix(docs, shard_words=300).collect()
    assert len(plan) == len(rows) and len(mixed) == sum(len(r.shards) for r in plan)
    per = defaultdict(int)
    for r in mixed:
        per[r.source, r._turn] += 1
    assert max(per.values()) <= 3 * 2 and len([k for k in per if k[0] == "s"]) > 400  # every repeated row has its own copies
    shards = defaultdict(int)
    for r in plan:
        for s in r.shards:
            shards[s] += r.size
    assert len(shards) == -(-sum(shards.values()) // 300) or len(shards) > 3


def test_mix_query(spark, sf):
    from loomwright.llm.queries import QUERIES

    rows = QUERIES["op6_mixing"](spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.size == len((docs[r.doc_id].text or "").split()) or "\x1c" <= "".join(docs[r.doc_id].text) <= "\uffff"
        sizes[docs[r.doc_id].source] += r.size
        taken[docs[r.doc_id].source] += r.taken
        assert r.taken in (0, r.size, 2 * r.size)
    want = water(sizes)
    largest = max(r.size for r in rows)
    assert len(rows) == len(docs) and all(abs(taken[s] - want[s]) <= largest / 2 + 1 for s in want)


def test_numbered_by_ranges(spark):
    from loomwright.llm.base import numbered

    rows = [(g, (i * 7) % 13, i % 5) for g in ("a", "b", None) for i in range(200)]
    got = numbered(spark.createDataFrame(rows, "g string, o int, v int").repartition(7), "g", F.col("o").desc(), F.col("v"), sums={"total": "v"}).collect()
    for g in ("a", "b", None):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(200)) and [(r.o, r.v) for r in mine] == sorted(((o, v) for _, o, v in rows[:200]), key=lambda x: (-x[0], x[1]))
        assert [r.total for r in mine] == list(np.cumsum([r.v for r in mine]))


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.plan(none).count() == mixing.mix(none).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {r.target for r in mixing.plan(empty).collect()} == {0.0}


def brute(rows, k, is_query):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, v in ok:
        if is_query(q):
            near = sorted((-float(sum(a * b for a, b in zip(v, x))), i) for i, x in ok if i != q)[:k]
            out += [(q, r + 1, i, -d) for r, (d, i) in enumerate(near)]
    return out


@pytest.mark.parametrize("factor", [1.0, 1.3])
def test_nearest(spark, factor):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=8))]) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(90)] + [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [None] * 8), (None, rows[1][1])]
    got = vptree.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0, k=7, factor=factor, shard=200, queries=16).collect()
    want = {(q, i) for q, _, i, _ in brute(rows, 7, lambda i: i % 20 == 0)}
    found = {(r.query_id, r.vec_id) for r in got}
    if factor == 1:
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(brute(rows, 7, lambda i: i % 20 == 0))
    assert len(found & want) >= 0.9 * len(want) and len(got) == len(want)
    assert vptree.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), lambda i: i % 20 == 0).count() == 0


def test_nearest_of_repeated_ids(spark):
    rng = np.random.default_rng(6)
    rows = [(i % 50, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(120)]
    got = vptree.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0, k=5, factor=1.0, shard=40, queries=2).collect()
    want = []
    for q in sorted({i for i, _ in rows if i % 20 == 0}):
        pairs = sorted((-sum(a * b for a, b in zip(v, x)), j) for i, v in rows if i == q and any(v) for j, x in rows if j != q and any(x))
        want += [(q, r + 1, j, -d) for r, (d, j) in enumerate(pairs[:5])]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_recall_of_the_registered_factor(spark, sf):
    v = spark.read.parquet(sf.replace("0.001", "0.1") + "/embeddings.parquet")
    got = {(r.query_id, r.vec_id) for r in vptree.nearest(v, lambda i: i % 20 == 0).collect()}
    rows = [(r.vec_id, list(r.embedding)) for r in v.collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([e for _, e in rows], float)
    want = set()
    for a in np.flatnonzero(ids % 20 == 0):
        s = x @ x[a]
        s[a] = -np.inf
        want |= {(int(ids[a]), int(ids[b])) for b in np.argsort(-s, kind="stable")[:20]}
    assert len(got & want) >= 0.9 * len(want)


def test_targets_against_sql(spark, sf):
    import duckdb

    from loomwright.llm.oracle import TARGETS

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = {s: (n, t) for s, n, t in con.execute(TARGETS).fetchall()}
    got = {r.source: (r.source_size, r.target) for r in mixing.plan(spark.read.parquet(sf + "/documents.parquet")).collect()}
    assert got.keys() == want.keys() and all(got[s][0] == want[s][0] and got[s][1] == pytest.approx(want[s][1]) for s in got)
