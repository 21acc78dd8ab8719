"""Operator 3: near-duplicates by Order MinHash.

A text is its sequence of five-word shingles, each labelled with its occurrence number. For each of BANDS hash functions
the LENGTH smallest labelled shingles are taken and kept in text order; a hash of that list is a bucket. Two texts share a
bucket's list with a chance that falls with reordering as well as with edits, so the sketch follows edit similarity.

Similarity of two texts: m / (a + b - m), with a and b their numbers of shingles and m the most labelled shingles that match
in the same order within a diagonal band (a banded alignment; labelled shingles occur once, so it is a longest increasing
subsequence). Pairs at 0.8 or more are linked; classes are connected components.

Texts of few shingles (SHORT + 2 to FEW) have lists of SHORT minima too: their lists of LENGTH would rarely agree at 0.8.

Work: equal texts collapse first (two 64-bit hashes and the length). A bucket compares its members with one hub, the text
that shares most, so a bucket of m texts of one class takes m - 1 pairs however large it is. Buckets that then hold several
classes are split: their texts meet again by the shingles of their prefixes (see ``prefixes``), which any two texts at 0.8
or more share, and which leave out what many texts have in common. There, members outside the main class (the one with
most members that were no hubs yet) become hubs, GROWTH times as many in each round, until all that are left belong to one
class. Every pair of open texts that can be linked is thus compared or already joined: no cap, and no row for two texts
that share only a passage or a line that others hold as well. Before texts are fetched, pairs must agree in length and in
their signatures (both exact, inside the join). All that do are compared by their texts.
A signature holds the parities of the numbers of shingles by BITS hash values (an odd sketch): each differing bit takes a
shingle that only one text has, and at 0.8 or more at most (a + b) / 9 are such.

Results by case: null texts have no class of others (each row is alone, ``class_id`` its own id); empty and wordless texts
likewise; texts of under five words are one shingle; repeated rows and ties share a class, whose id is the smallest
doc_id; rows with equal doc_id and other texts
are one document that any of its texts links; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.base import WORD, dropped, stored

K, SIMILAR = 5, 0.8
BANDS, LENGTH, SHORT, FEW = 32, 6, 2, 16
#: Bits of a text's signature.
BITS = 512
#: Hubs of a prefix's shingle grow so many times in each round.
GROWTH = 256
#: Matches may lie this share of the longer text off the diagonal, and at least BAND shingles.
SLACK, BAND = 0.25, 64

WORDS = re.compile(WORD).findall
MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xorshift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    return x * np.uint64(0xD6E8FEB86659FD93)


class Shingler:
    """Hashes of labelled shingles; words are hashed once while they stay in a bounded memo."""

    def __init__(self, memo: int = 150_000):
        import xxhash

        self.memo, self.known, self.hash = memo, {}, xxhash.xxh3_64_intdigest

    def words(self, text: str) -> np.ndarray:
        known, words = self.known, WORDS(text)
        if len(known) > self.memo:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = self.hash(w)
                if len(w) <= 64:
                    known[w] = h
            out.append(h)
        return np.array(out, np.uint64)

    def shingles(self, text: str) -> np.ndarray:
        w = self.words(text)
        if not len(w):
            return w
        k = min(K, len(w))
        s = np.zeros(len(w) - k + 1, np.uint64)
        for i in range(k):
            s = mixed(s + w[i : len(w) - k + 1 + i] + np.uint64(i + 1))
        order = np.argsort(s, kind="stable")
        first = s[order]
        new = np.concatenate(([True], first[1:] != first[:-1]))
        if not new.all():  # label by occurrence number
            starts = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
            label = np.empty(len(s), np.uint64)
            label[order] = (np.arange(len(s)) - starts).astype(np.uint64)
            s = np.where(label > 0, mixed(s + label * np.uint64(0x9E3779B97F4A7C15)), s)
        return s


RNG = np.random.default_rng(20240607)
MULTIPLIERS = (RNG.integers(1, MASK, BANDS, np.uint64, True) | np.uint64(1))[:, None]
SHIFTS = RNG.integers(0, MASK, BANDS, np.uint64, True)[:, None]
ODD = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(LENGTH)], np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """BITS parities, as numbers of 64 bits."""
    n = np.bincount((s >> np.uint64(65 - BITS.bit_length())).astype(np.int64), minlength=BITS)
    return np.packbits((n & 1).astype(np.uint8)).view(np.int64)


def listed(h: np.ndarray, i: np.ndarray, first: int) -> np.ndarray:
    """Bucket of each band, numbered from first: a hash of its minima h in the order of their places i."""
    kept = np.take_along_axis(h, np.argsort(i, 1), 1)
    return mixed((kept * ODD[: h.shape[1]]).sum(1) + np.arange(first, first + BANDS, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def sketch(s: np.ndarray) -> np.ndarray:
    """Buckets, BANDS or twice as many."""
    take = min(LENGTH, len(s))
    step, parts_h, parts_i = 1 << 14, [], []
    for at in range(0, len(s), step):  # bounded memory for very long texts
        h = s[None, at : at + step] * MULTIPLIERS + SHIFTS
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xD6E8FEB86659FD93)
        n = min(take, h.shape[1])
        low = np.argpartition(h, n - 1, 1)[:, :n] if n < h.shape[1] else np.broadcast_to(np.arange(n), (BANDS, n))
        parts_h.append(np.take_along_axis(h, low, 1))
        parts_i.append(low + at)
    h, i = np.concatenate(parts_h, 1), np.concatenate(parts_i, 1)
    if h.shape[1] > take:
        low = np.argpartition(h, take - 1, 1)[:, :take]
        h, i = np.take_along_axis(h, low, 1), np.take_along_axis(i, low, 1)
    buckets = listed(h, i, 0)
    if SHORT + 2 <= len(s) <= FEW:
        low = np.argpartition(h, SHORT - 1, 1)[:, :SHORT]
        buckets = np.concatenate((buckets, listed(np.take_along_axis(h, low, 1), np.take_along_axis(i, low, 1), BANDS)))
    return buckets


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two shingle sequences by banded alignment; below SIMILAR it may be an upper bound."""
    if not len(a) or not len(b):
        return 0.0
    least = SIMILAR * (len(a) + len(b)) / (1 + SIMILAR)
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = max(BAND, int(SLACK * max(len(a), len(b))))
    near = np.abs(at_a - at_b) <= band
    at_a, at_b = at_a[near], at_b[near]
    if len(at_a) < least - 1e-9:
        return len(at_a) / (len(a) + len(b) - len(at_a))
    seq = at_b[np.argsort(at_a)]
    if (np.diff(seq) > 0).all():
        m = len(seq)
    else:
        tails: list[int] = []
        for x in seq.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        m = len(tails)
    return m / (len(a) + len(b) - m)


SKETCH = "doc_id long, digest long, n_chars long, n long, buckets array<long>, bits array<long>"


def sketches(docs: DataFrame) -> DataFrame:
    def run(batches):
        import xxhash

        shingler = Shingler()
        for batch in batches:
            ids, texts, rows = batch.column(0), batch.column(1), []
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                s = shingler.shingles(text or "")
                row = [ids[i].as_py(), xxhash.xxh64_intdigest(text or "", 3) - (1 << 63), len(text or ""), len(s), [], []]
                if len(s):
                    row[4:] = sketch(s).astype(np.int64), signature(s)
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=["doc_id", "digest", "n_chars", "n", "buckets", "bits"])

    return docs.mapInArrow(run, SKETCH)


def verified(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with texts ta, tb at SIMILAR or more."""

    def run(batches):
        shingler = Shingler()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, ok, last, known = batch.slice(at, 256), [], None, None
                for x, y in zip(part.column(2), part.column(3), strict=True):
                    y = y.as_py()
                    if y != last:
                        last, known = y, shingler.shingles(y)
                    ok.append(similarity(shingler.shingles(x.as_py()), known) >= SIMILAR - 1e-12)
                kept = part.filter(pa.array(ok, pa.bool_()))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, root): the least id of each connected component, for ids with links.

    A round joins every node's greater neighbours, then its lesser ones, to its least neighbour; rounds grow with the
    logarithm of the longest chain. A hub of many edges only meets aggregates and joins that Spark may split.
    """
    sign = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = sign(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        last, edges = edges, stored(small.where("u <> v").distinct(), "edges")
        dropped(links.sparkSession, last)
        after = sign(edges)
        if after == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = after


def opened(texts: DataFrame) -> DataFrame:
    """(rep, text) rows with their shingles: ``rep, id`` (of the text), ``text, s``."""

    def run(batches):
        import xxhash

        shingler = Shingler()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                bodies = part.column(1).to_pylist()
                ids = pa.array([xxhash.xxh64_intdigest(t, 5) - (1 << 63) for t in bodies], pa.int64())
                grams = pa.array([shingler.shingles(t).astype(np.int64) for t in bodies], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, part.column(1), grams], names=["rep", "id", "text", "s"])

    return texts.select("rep", "text").mapInArrow(run, "rep long, id long, text string, s array<long>")


def prefixes(texts: DataFrame) -> DataFrame:
    """``bucket, rep``: the shingles of each opened text's prefix, without those that no other text holds.

    In one order of all shingles, two texts at SIMILAR or more share one of the first a - ceil(SIMILAR * a) + 1 of theirs:
    else all that they share would lie in the rest of one of them, which is less than the SIMILAR * a that they must share.
    Rare shingles come first, so texts that share what many others hold, and nothing else, do not meet.
    """
    grams = texts.select("rep", "id", F.size("s").alias("a"), F.explode("s").alias("bucket"))
    often = stored(grams.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"), "often")
    held = grams.join(often, "bucket").groupBy("rep", "id", "a").agg(F.sort_array(F.collect_list(F.struct("c", "bucket"))).alias("l"))
    # shingles that no other text holds are the first of a prefix
    most = F.col("a") - F.ceil(F.col("a") * F.lit(SIMILAR) - 1e-9) + 1 - (F.col("a") - F.size("l"))
    return held.where(most > 0).select("rep", F.explode(F.slice("l", F.lit(1), most.cast("int")))).select("col.bucket", "rep").distinct()


class Classes:
    """Links found so far, the classes that they make, and what was compared."""

    def __init__(self, texts: DataFrame):
        self.texts, self.links, self.roots, self.compared = texts, None, None, None

    def rooted(self, state: DataFrame) -> DataFrame:
        """state with the ``root`` of each member's class."""
        if self.roots is None:
            return state.withColumn("root", F.col("rep"))
        return state.drop("root").join(self.roots.withColumnRenamed("id", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))

    def compare(self, state: DataFrame, hubs: DataFrame) -> DataFrame:
        """Compare each bucket's members with its hubs; state with the new classes, and its hubs done."""
        h = state.join(hubs, ["bucket", "rep"], "left_semi").select("bucket", F.col("rep").alias("y"), F.col("root").alias("ry"), F.col("n").alias("ny"), F.col("bits").alias("other"))
        # (a + b) * (1 - SIMILAR) / (1 + SIMILAR) shingles at most are in one text only
        differing = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("other")[i])) for i in range(1, BITS // 64)), F.bit_count(F.col("bits")[0].bitwiseXOR(F.col("other")[0])))
        pairs = state.join(h, "bucket").where(f"root <> ry AND n >= {SIMILAR} * ny AND ny >= {SIMILAR} * n").where(differing * (1 + SIMILAR) <= (F.col("n") + F.col("ny")) * (1 - SIMILAR) + 1e-6)
        pairs = pairs.select(F.greatest("rep", "y").alias("a"), F.least("rep", "y").alias("b")).distinct()
        pairs = stored(pairs if self.compared is None else pairs.join(self.compared, ["a", "b"], "left_anti"), "pairs")
        self.compared = pairs if self.compared is None else self.compared.union(pairs)
        state = state.join(hubs.withColumn("new", F.lit(True)), ["bucket", "rep"], "left").withColumn("done", F.col("done") | F.coalesce("new", F.lit(False))).drop("new")
        if pairs.isEmpty():
            return state
        ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        wanted = stored(self.texts.join(ids, "rep", "left_semi"), "wanted")
        full = pairs.join(wanted.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a").join(wanted.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b")
        found = stored(verified(full).distinct(), "links")
        dropped(found.sparkSession, wanted)
        if found.isEmpty():
            return state
        self.links = found if self.links is None else self.links.union(found)
        if self.roots is None:
            self.roots = components(found)
            return self.rooted(state)
        # only the classes that the links join are gone through again
        ends = found
        for end in "ab":
            ends = ends.join(self.roots.withColumnRenamed("id", end), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        joined = components(ends.select("a", "b"))
        moved = self.roots.join(joined.select(F.col("id").alias("root"), F.col("root").alias("to")), "root", "left")
        self.roots = stored(moved.select("id", F.coalesce("to", "root").alias("root")).union(joined), "roots")
        return self.rooted(state)


def unsettled(state: DataFrame) -> DataFrame:
    """``bucket, main``: buckets of several classes, more than one with members that were no hubs, and the one with most such."""
    classes = state.groupBy("bucket", "root").agg(F.count_if(~F.col("done")).alias("rest"))
    main = classes.groupBy("bucket").agg(F.count("*").alias("k"), F.sum("rest").alias("all"), F.max(F.struct("rest", "root")).alias("main"))
    return main.where("k > 1 AND all > main.rest").select("bucket", F.col("main.root").alias("main"))


def best(state: DataFrame, *by: str) -> DataFrame:
    """``bucket, rep``: of each group, the member of most weight, or the least of these."""
    rep = -F.max(F.struct("weight", (-F.col("rep")).alias("minus")))["minus"]
    return stored(state.groupBy(*by).agg(rep.alias("rep")).select("bucket", "rep"), "hubs")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: ``doc_id``, ``class_id`` (least doc_id of its class) and ``n_links`` (verified links of its text)."""
    base = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    drawn = stored(sketches(base), "sketches")
    same = ["digest", "n_chars", "h"]
    keyed = drawn.withColumn("h", F.xxhash64("buckets", "n"))
    texts = keyed.where("n > 0 AND doc_id IS NOT NULL").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("buckets").alias("buckets"), F.first("bits").alias("bits"))
    texts = stored(texts, "texts")
    members = texts.select(F.explode("buckets").alias("bucket"), "rep", "n").distinct()
    shared = members.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    members = stored(members.join(shared, "bucket"), "members")
    # A text amid near copies shares more buckets with them than they do with each other: it is their best hub.
    about = members.groupBy("rep").agg(F.sum("c").alias("weight")).join(texts.select("rep", "bits"), "rep")
    state = stored(members.drop("c").join(about, "rep").withColumns({"root": F.col("rep"), "done": F.lit(False)}), "state")
    classes = Classes(base.withColumnRenamed("doc_id", "rep"))
    state = stored(classes.compare(state, best(state, "bucket")), "state")
    open_ = stored(unsettled(state), "unsettled")
    if not open_.isEmpty():
        # Texts of these buckets meet again by their prefixes
        reps = stored(state.join(open_, "bucket").groupBy("rep").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("weight").alias("weight")), "reps")
        classes.texts = stored(opened(classes.texts.join(reps, "rep", "left_semi").distinct()), "opened")
        groups = stored(prefixes(classes.texts), "prefixes")
        classes.texts = classes.texts.select("rep", "text")
        shared = groups.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
        state = stored(classes.rooted(groups.join(shared, "bucket").join(reps, "rep").withColumn("done", F.lit(False))), "state")
        turn = 1
        while True:
            open_ = stored(unsettled(state), "unsettled")
            if open_.isEmpty():
                break
            state = stored(state.join(open_, "bucket"), "state")
            share = F.pmod(F.xxhash64("rep", F.lit(turn)), F.lit(GROWTH**turn))
            hubs = best(state.where("NOT done AND root <> main").withColumn("share", share), "bucket", "share")
            state = classes.compare(state.drop("main"), hubs)
            turn += 1
    out = keyed.join(texts.select(*same, "rep"), same, "left")
    if classes.roots is not None:
        degree = classes.links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
        out = out.join(classes.roots.withColumnRenamed("id", "rep"), "rep", "left").join(degree, "rep", "left")
    else:
        out = out.withColumns({"root": F.lit(None).cast("long"), "n_links": F.lit(None).cast("long")})
    return out.select("doc_id", F.when(F.col("n") > 0, F.coalesce("root", "rep", "doc_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
