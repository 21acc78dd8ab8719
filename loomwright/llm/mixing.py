"""Operator 6: mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share 150 % of all words; a target stops at twice its
source's words, and what it can't take is shared again by weight. That is min(2 * words, level * weight) at one level.

Quotas: a source's documents are dealt by hash into blocks of about BLOCK_DOCS, in a random order given by hash. A source
whose target is r times its words is passed over floor(r) times whole; the last, partial pass takes blocks in order while
they fit the rest of the target, then documents of the next block while they fit, then the one document that brings the
total nearest. So the total is off by less than half a document, and no document is taken more than twice.

Splitting tree: the numbers of drawn blocks by source are the colours of an urn. A node with several output shards draws the
left half's share without replacement (a multivariate hypergeometric draw, colour by colour), down to single shards; each
shard gets a disjoint range of each source's permuted draws, and its rows are ordered by hash. The urn's colours are BUNDLES
of sources at first; a bundle's share of each shard is then dealt to its sources by a tree of the same kind, so neither the
driver nor a node holds more than BUNDLES colours, however many sources there are. A node's seed is its place, so nodes are
independent of each other and of the cluster, and reruns agree.

Only (id, source, size) rows are shuffled for the plan. Running numbers and sums are made by ranges (``base.numbered``); windows
run over one block only.

Results by case: null texts have size 0, as have wordless ones (taken 0, copied as often as their block); a null source is
a source of its own; repeated rows are separate documents; an empty table, or one without words, gives targets of 0; extra
columns stay, clashing ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.base import WORD, fresh, numbered, stored

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
BLOCK_DOCS, BUNDLES = 64, 1024
SHARD_WORDS = 4_000_000
SEED = 20240611
#: Repeated rows that one task numbers at a time.
RUN = 65_536


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, n_docs, source_size, weight, target`` for each source."""
    s = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size")).withColumn("all", F.lit(0))
    s = numbered(s, "all", F.col("source").asc_nulls_last())
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))).drop("place")
    s = s.withColumn("ratio", F.col("source_size") / F.col("weight"))
    s = numbered(s, "all", F.col("ratio"), F.col("source").asc_nulls_last(), sums={"sizes": "source_size", "weights": "weight"}).drop("place")
    total = s.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    s = s.withColumn("level", (F.lit((total.size or 0) * float(share)) - (F.col("sizes") - F.col("source_size")) * float(most)) / (F.lit(total.weight or 0.0) - (F.col("weights") - F.col("weight"))))
    # from the first source that isn't filled up, one level holds
    held = s.where(F.col("level") <= F.col("source_size") * float(most) / F.col("weight")).agg(F.min(F.struct("ratio", "level")).alias("first")).first()["first"]
    full = F.col("source_size") * float(most)
    return s.withColumn("target", full if held is None else F.least(full, F.lit(held.level) * F.col("weight"))).select("source", "n_docs", "source_size", "weight", "target")


def split_urn(counts: np.ndarray, want: int, seed) -> np.ndarray:
    """Of counts by colour, a share of want, drawn without replacement."""
    rng = np.random.default_rng(seed)
    total, left = int(counts.sum()), counts * 0
    for i, c in enumerate(counts.tolist()):
        if want and c:
            left[i] = rng.hypergeometric(c, total - c, want) if total > c else want
            want -= int(left[i])
        total -= c
    return left


def splitting_tree(counts: np.ndarray, shards: int, node: int = 1, first: int = 0, starts: np.ndarray | None = None, depth: int = 99, seed: int = SEED):
    """Leaves, or subtrees at the depth: (first shard, shards, node, starts, counts); starts are places in each colour's draws."""
    counts = np.asarray(counts, np.int64)
    work = [(first, shards, node, np.zeros_like(counts) if starts is None else np.asarray(starts, np.int64), counts, depth)]
    while work:
        at, n, k, begin, c, d = work.pop()
        if n == 1 or d == 0:
            yield at, n, k, begin, c
            continue
        left = split_urn(c, int(c.sum()) * (n // 2) // n, (seed, k))
        work.append((at + n // 2, n - n // 2, 2 * k + 1, begin + left, c - left, d - 1))
        work.append((at, n // 2, 2 * k, begin, left, d - 1))


def dealt_out(counts: np.ndarray, sizes: np.ndarray, seed):
    """The same for a urn whose shards' sizes are given: (place of the size, starts, counts) for each shard that gets some.

    Only colours that a node still holds go down with it.
    """
    upto = np.concatenate(([0], np.cumsum(sizes)))
    work = [(0, len(sizes), 1, np.arange(len(counts)), np.zeros(len(counts), np.int64), np.asarray(counts, np.int64))]
    while work:
        lo, hi, k, colours, begin, c = work.pop()
        some = c > 0
        colours, begin, c = colours[some], begin[some], c[some]
        if not len(c):
            continue
        if hi - lo == 1:
            yield lo, colours, begin, c
            continue
        mid = (lo + hi) // 2
        left = split_urn(c, int(upto[mid] - upto[lo]), (*seed, k))
        work.append((mid, hi, 2 * k + 1, colours, begin + left, c - left))
        work.append((lo, mid, 2 * k, colours, begin, left))


def drawn_ranges(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``source, shard, start, n``: the range of each source's draws (quotas: source, k) that a shard gets."""
    spark = quotas.sparkSession
    quotas = quotas.withColumn("bundle", F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(BUNDLES)).cast("int"))
    urn = sorted(quotas.groupBy("bundle").agg(F.sum("k").alias("k")).where("k > 0").collect())  # at most BUNDLES rows
    names = [r.bundle for r in urn]
    subtrees = [(a, n, str(k), b.tolist(), c.tolist()) for a, n, k, b, c in splitting_tree(np.array([r.k for r in urn], np.int64), shards, depth=6, seed=seed)] if urn else []

    def grow(frames):
        for f in frames:
            for r in f.itertuples():
                for at, _, _, _, c in splitting_tree(np.array(r.counts), r.n, int(r.node), r.at, np.array(r.starts), seed=seed):
                    some = np.flatnonzero(c)
                    yield pd.DataFrame({"bundle": [names[i] for i in some], "shard": at, "n": c[some]})

    forest = spark.createDataFrame(subtrees, "at int, n int, node string, starts array<long>, counts array<long>").repartition(max(1, len(subtrees)))
    leaves = forest.mapInPandas(grow, "bundle int, shard int, n long")

    def deal(key, sources: pd.DataFrame, shares: pd.DataFrame) -> pd.DataFrame:
        sources = sources.assign(last=sources["source"].isna()).sort_values(["last", "source"], kind="stable")
        shares, names_, out = shares.sort_values("shard"), sources["source"].to_numpy(), []
        shard = shares["shard"].to_numpy()
        for at, colours, begin, c in dealt_out(sources["k"].to_numpy(), shares["n"].to_numpy(), (seed, int(key[0]) + 1)):
            out.append((names_[colours], np.full(len(c), shard[at]), begin, c))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [[], [], [], []]
        return pd.DataFrame(dict(zip(("source", "shard", "start", "n"), columns))).astype({"source": object, "shard": "int32", "start": "int64", "n": "int64"})

    return quotas.select("bundle", "source", "k").groupBy("bundle").cogroup(leaves.groupBy("bundle")).applyInPandas(deal, "source string, shard int, start long, n long")


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """A row per row of docs: ``doc_id, digest, source, size, source_size, target, shards`` (the output shard of each copy), ``n``.

    Rows that agree in id, text and source are numbered by n.
    """
    body = F.col(f"`{text}`").cast("string")
    sizes = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.xxhash64(body).alias("digest"), F.col(f"`{source}`").cast("string").alias("source"), F.coalesce(F.regexp_count(body, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = stored(sizes, "sizes")
    targets = stored(source_targets(sizes), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumns({"blocks": F.greatest(F.lit(1), F.floor(F.col("n_docs") / BLOCK_DOCS)).cast("long"), "whole": whole}).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    by_source = F.broadcast(targets) if targets.count() <= 100_000 else targets
    same = ["source", "doc_id", "digest", "size"]
    runs = sizes.groupBy(*same).agg(F.count("*").alias("c")).select(*same, "c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / RUN))).alias("k")).repartition(*same, "k")
    rows = runs.select(*same, F.explode(F.sequence(F.col("k") * RUN + 1, F.least("c", (F.col("k") + 1) * RUN))).alias("n"))
    dealt = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "digest", "n")).join(by_source.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("block", F.pmod("h", "blocks"))
    dealt = stored(dealt, "dealt")
    per_block = dealt.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("part").alias("part"), F.first("whole").alias("whole"))
    per_block = numbered(per_block, "source", F.xxhash64(F.lit(seed + 1), "source", "block"), F.col("block"), sums={"until": "words"})
    fits = (F.col("until") <= F.col("part")) & (F.col("whole") < MOST)
    edge = ~fits & (F.col("until") - F.col("words") <= F.col("part")) & (F.col("whole") < MOST)
    per_block = stored(per_block.withColumns({"fits": fits, "edge": edge, "room": F.col("part") - F.col("until") + F.col("words")}), "blocks")
    # the block in which the partial pass ends: its documents in order, then the one that comes nearest
    inside = dealt.join(per_block.where("edge").select(F.col("source").alias("s"), F.col("block").alias("b"), "room"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b")
    v = Window.partitionBy("source").orderBy("h", "doc_id", "digest", "n").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("until", F.sum("size").over(v)).withColumn("fits", F.col("until") <= F.col("room"))
    group = Window.partitionBy("source")
    rest = F.col("room") - F.coalesce(F.max(F.when(F.col("fits"), F.col("until"))).over(group), F.lit(0))
    inside = inside.withColumn("off", F.when(~F.col("fits") & (F.col("size") > 0), F.abs(rest - F.col("size")))).withColumn("gain", F.col("off") < rest)
    nearest = F.row_number().over(Window.partitionBy("source").orderBy(F.col("off").asc_nulls_last(), "h", "doc_id", "digest", "n"))
    inside = inside.withColumn("t", F.col("fits") | (F.coalesce(F.col("gain"), F.lit(False)) & (nearest == 1))).where("t")
    extra = inside.select(F.col("source").alias("s"), F.col("doc_id").alias("i"), F.col("digest").alias("x"), F.col("n").alias("m"), "t")
    # draws of blocks: whole passes, the blocks of the partial pass that fit, and the one that is partly taken
    quotas = per_block.groupBy("source").agg(F.sum(F.col("whole") + (F.col("fits") | F.col("edge")).cast("long")).alias("k"), F.sum(F.col("words") * F.col("whole") + F.when(F.col("fits"), F.col("words")).otherwise(0)).alias("words"), F.count("*").alias("n_blocks"))
    quotas = stored(quotas, "quotas")
    shards = max(1, -(-int(quotas.agg(F.sum("words")).first()[0] or 0) // shard_words))
    # a source's draws in order: pass by pass, each in the blocks' random order
    ranges = drawn_ranges(quotas, shards, seed).join(quotas.select(F.col("source").alias("s"), "n_blocks"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    draws = ranges.select("source", "n_blocks", "shard", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("draw"))
    draws = draws.groupBy("source", (F.col("draw") % F.col("n_blocks")).alias("place")).agg(F.transform(F.sort_array(F.collect_list(F.struct("draw", "shard"))), lambda t: t["shard"]).alias("shards"))
    placed = per_block.select(F.col("source").alias("s"), F.col("block").alias("b"), F.col("place").alias("p"), "edge").join(draws, F.col("s").eqNullSafe(F.col("source")) & (F.col("p") == F.col("place")), "left").select("s", "b", "edge", "shards")
    out = dealt.join(placed, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b")
    out = out.join(extra, F.col("edge") & F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("i")) & F.col("digest").eqNullSafe(F.col("x")) & (F.col("n") == F.col("m")), "left")
    copies = F.col("whole") + F.when(F.col("edge"), F.col("t").isNotNull().cast("int")).otherwise(1)
    shards_ = F.coalesce(F.col("shards"), F.array().cast("array<int>"))
    return stored(out.select("doc_id", "digest", "source", "size", "source_size", "target", F.slice(shards_, F.lit(1), F.least(F.size(shards_), copies.cast("int"))).alias("shards"), "n"), "plan")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixture: a copy of a row of docs for each draw, with ``mix_shard`` and ``mix_place``, the order inside of its shard."""
    out = ["mix_shard", "mix_place"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in out])
    i, x, s, n, turn, group, i2, x2, s2, n2, sh = fresh(docs, "id", "digest", "src", "n", "turn", "group", "id2", "digest2", "src2", "n2", "shards")
    p = plan(docs, key, text, source, **options).select(F.col("doc_id").alias(i2), F.col("digest").alias(x2), F.col("source").alias(s2), F.col("n").alias(n2), F.col("shards").alias(sh))
    rows = docs.withColumns({i: F.col(f"`{key}`").cast("long"), x: F.xxhash64(F.col(f"`{text}`").cast("string")), s: F.col(f"`{source}`").cast("string")})
    match = F.col(i).eqNullSafe(F.col(i2)) & F.col(x).eqNullSafe(F.col(x2)) & F.col(s).eqNullSafe(F.col(s2))
    repeated = stored(p.where(F.col(n2) > 1).select(i2, x2, s2).distinct(), "repeated")
    if repeated.isEmpty():
        rows = rows.withColumn(n, F.lit(1).cast("long"))
    else:
        many = numbered(rows.join(repeated, match, "left_semi").withColumn(group, F.struct(i, x, s)), group, place=n).withColumn(n, F.col(n) + 1).drop(group)
        rows = rows.join(repeated, match, "left_anti").withColumn(n, F.lit(1).cast("long")).unionByName(many)
    rows = rows.join(p.where(F.size(sh) > 0), match & (F.col(n) == F.col(n2)))
    rows = rows.select(*[F.col(f"`{a}`") for a in docs.columns], F.posexplode(sh).alias(turn, out[0]), F.col(i), F.col(x), F.col(n))
    return rows.withColumn(out[1], F.xxhash64(F.lit(SEED + 2), out[0], turn, i, x, n)).drop(turn, i, x, n)
