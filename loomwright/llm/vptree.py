"""Operator 7: nearest neighbours by vantage-point trees, one per shard.

Largest inner product becomes nearest point: each vector gets one more component, sqrt(M - |x|^2) with M the greatest squared
length, and the query gets 0 there; then |q' - x'|^2 = |q|^2 + M - 2 q.x, a metric. A shard holds about SHARD vectors. Its
tree splits a set at the median distance from a vantage point; a side is searched only if the triangle inequality leaves
room: the query's distance to the vantage point differs from the side's nearest shell by less than the best k-th distance
so far divided by ``factor``. Factor 1 is exact; larger factors prune more. Leaves hold at most LEAF vectors and a block of
queries descends together, so distances are matrix products.

Each tree is built once and stored. Queries go past the trees in blocks of QUERIES, broadcast (their number is the bound); a
task takes its trees one after the other, and the k best that it has found so far prune the next tree too. It returns one
list for each query, so what is shuffled grows with the queries, not with queries times shards.

Every row is indexed; nothing is sampled. Scores are summed in component order in double precision on the original
vectors, so equal vectors tie exactly and ties go to the smaller id.

Results by case: vectors that are null, zero, or hold null or non-finite components take no part, as queries or
candidates; repeated ids are separate candidates (a query's own id is left out of its result), and a repeated query id has one result, the
best pairs of all its rows; with fewer candidates than
k all are returned; vectors of another length than the most common one raise an error; an empty table gives no rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.base import stored

SHARD, QUERIES, LEAF, FAN = 8192, 8192, 128, 64


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Row by row inner products, summed in component order."""
    out = np.zeros(len(rows))
    for d in range(rows.shape[1]):
        out += queries[:, d] * rows[:, d]
    return out


def lift(x: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate((x, np.sqrt(np.maximum(0, most - (x * x).sum(1)))[:, None]), 1)


def build(points: np.ndarray, leaf: int = LEAF) -> list:
    """Nodes in preorder: (vantage row, inner shell lo, hi, outer shell lo, hi, inner node, outer node) or a leaf's rows."""
    rng = np.random.default_rng(7)
    nodes: list = []
    work = [(np.arange(len(points)), -1, 0)]
    while work:
        rows, parent, side = work.pop()
        at = len(nodes)
        if parent >= 0:
            nodes[parent][5 + side] = at
        if len(rows) <= leaf:
            nodes.append(rows)
            continue
        v = int(rows[rng.integers(len(rows))])
        d = np.sqrt(np.maximum(0, ((points[rows] - points[v]) ** 2).sum(1)))
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        near, far = order[:half], order[half:]
        nodes.append([v, d[near].min(), d[near].max(), d[far].min(), d[far].max(), -1, -1])
        work += [(rows[far], at, 1), (rows[near], at, 0)]
    return nodes


def search(nodes: list, points: np.ndarray, queries: np.ndarray, k: int, factor: float, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, squared distances) of the k nearest of each query, -1 and inf where there are fewer.

    With a bound (squared) for each query, points that are farther may be missed.
    """
    n = len(queries)
    bound = np.full(n, np.inf) if bound is None else bound
    best, which = np.full((n, k), np.inf), np.full((n, k), -1)
    norms = (points * points).sum(1)
    qnorms = (queries * queries).sum(1)

    def visit(at: int, who: np.ndarray) -> None:
        node = nodes[at]
        if isinstance(node, np.ndarray):
            d = np.maximum(0, qnorms[who, None] + norms[None, node] - 2 * queries[who] @ points[node].T)
            both, ids = np.concatenate((best[who], d), 1), np.concatenate((which[who], np.broadcast_to(node, d.shape)), 1)
            keep = np.argpartition(both, k - 1, 1)[:, :k]
            best[who], which[who] = np.take_along_axis(both, keep, 1), np.take_along_axis(ids, keep, 1)
            return
        v, near_lo, near_hi, far_lo, far_hi, near, far = node
        d = np.sqrt(np.maximum(0, qnorms[who] + norms[v] - 2 * queries[who] @ points[v]))
        first_near = d <= (near_hi + far_lo) / 2
        for side, lo, hi, mine in ((near, near_lo, near_hi, first_near), (far, far_lo, far_hi, ~first_near), (near, near_lo, near_hi, ~first_near), (far, far_lo, far_hi, first_near)):
            gap = np.maximum(0, np.maximum(lo - d, d - hi))
            go = who[mine & (gap * factor <= np.sqrt(np.minimum(best[who].max(1), bound[who])) * (1 + 1e-9) + 1e-9)]
            if len(go):
                visit(side, go)

    if len(points):
        visit(0, np.arange(n))
    return which, best


def nearest(vectors: DataFrame, is_query, k: int = 20, factor: float = 1.3, vec_id: str = "vec_id", embedding: str = "embedding", shard: int = SHARD, queries: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows where is_query holds, against all other rows.

    Vectors are dealt into shards, and queries into blocks, of bounded size by hash. The k best of all tasks are chosen from
    their lists.
    """
    v = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("x"))
    ok = ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("x", lambda c: c != 0)
    v = stored(v.where(F.col("id").isNotNull() & F.col("x").isNotNull()).where(ok).withColumn("q", is_query(F.col("id"))), "vectors")
    size = v.agg(F.count("*").alias("n"), F.count_if("q").alias("m"), F.max(F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c)).alias("most"), F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("hi")).first()
    if size.n and size.lo != size.hi:
        raise ValueError("vectors differ in length")
    shards, blocks, most = max(1, -(-size.n // shard)), max(1, -(-size.m // queries)), float(size.most or 0)
    deal = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")

    def grow(key, points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("id", kind="stable", ignore_index=True)
        x, back = np.unique(np.stack(points["x"].to_numpy()).astype(float), axis=0, return_inverse=True)
        # equal vectors are one point of the tree; as ties go to smaller ids, its k + 1 smallest ids hold all that can be asked for
        members, size = np.argsort(back.ravel(), kind="stable"), np.bincount(back.ravel(), minlength=len(x))
        ids = points["id"].to_numpy()[members]
        return pd.DataFrame({"s": [key[0]], "tree": [pickle.dumps((ids, np.cumsum(size) - size, size, x, build(lift(x, most))))]})

    trees = stored(v.select(deal(1, shards).alias("s"), "id", "x").groupBy("s").applyInPandas(grow, "s int, tree binary"), "trees")

    def past(batches, own: np.ndarray, q: np.ndarray):
        from pyspark import TaskContext

        n, norms = len(own), (q * q).sum(1) + most
        lifted_q = np.concatenate((q, np.zeros((n, 1))), 1)
        score, found = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        for batch in batches:
            for blob in batch.column(1):
                ids, begin, size, x, nodes = pickle.loads(blob.as_py())
                bound = np.maximum(0, norms - 2 * score[:, -1])
                which, _ = search(nodes, lift(x, most), lifted_q, min(len(x), k + 8), factor, bound)
                a, c = np.nonzero(which >= 0)
                point = which[a, c]
                s = products(q[a], x[point])
                many = np.minimum(size[point], k + 1)
                row = np.repeat(np.arange(len(a)), many)
                new = ids[begin[point][row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)]
                a, s = a[row], s[row]
                keep = new != own[a]
                old_a, old_c = np.nonzero(score > -np.inf)
                a, s, new = np.concatenate((a[keep], old_a)), np.concatenate((s[keep], score[old_a, old_c])), np.concatenate((new[keep], found[old_a, old_c]))
                order = np.lexsort((new, -s, a))
                a, s, new = a[order], s[order], new[order]
                rank = np.arange(len(a)) - np.searchsorted(a, a)
                top = rank < k
                score[a[top], rank[top]], found[a[top], rank[top]] = s[top], new[top]
        a, c = np.nonzero(score > -np.inf)
        group = np.full(len(a), TaskContext.get().partitionId() // FAN, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(own[a]), pa.array(found[a, c]), pa.array(score[a, c])], names=["g", "query_id", "vec_id", "score"])

    found = None
    for b in range(blocks):
        asked = v.where(F.col("q") & (deal(2, blocks) == b)).select("id", "x").toPandas().sort_values("id", kind="stable")  # about QUERIES rows
        if not len(asked):
            continue
        block = vectors.sparkSession.sparkContext.broadcast((asked["id"].to_numpy(np.int64), np.stack(asked["x"].to_numpy()).astype(float)))
        some = stored(trees.mapInArrow(lambda batches, block=block: past(batches, *block.value), "g int, query_id long, vec_id long, score double"), "found")
        found = some if found is None else found.union(some)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k).alias("top")
    best = found.groupBy("query_id", "g").agg(lists).select("query_id", F.inline("top")).select("query_id", (-F.col("far")).alias("score"), "vec_id").groupBy("query_id").agg(lists)
    return best.select("query_id", F.posexplode("top").alias("rank", "t")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.far")).alias("score"))
