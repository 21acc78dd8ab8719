"""Operator 2: quality classifier by co-training.

Two views of a document: its words and word shapes (text), and its source, language and length (metadata). Each has a
logistic model over hashed features. In every round both models are fitted; each then labels the unlabelled pool, and its
most confident labels join the other's training set. At the end both views are calibrated (Platt) and combined by a
logistic model of the two log-odds on a calibration fold, and the cutoff keeps all but FALSE_REJECTION of all good documents
that were neither trained nor calibrated on, however many: their scores are counted in bins. Every document is scored once,
and the scores are stored, so that no text goes through a join.

The labelled rows and the pool are bounded samples by hash (LABELLED, POOL: documented parameters); every document is
scored, in whole. Weights are broadcast: their size is fixed (2 * DIM numbers).

Results by case: null and empty texts are scored by the intercept and their metadata; null metadata is a value of its own;
without labels of both classes all scores are 0.5 and everything is kept; repeated rows get equal scores; documents with
several labels are good only if all are; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.base import stored

DIM = 1 << 15
LABELLED, POOL, ROUNDS, GROW, CONFIDENT = 4000, 4000, 4, 400, 0.95
FALSE_REJECTION = 0.002

LETTERS = {i: "a" for i in range(97, 123)} | {i: "A" for i in range(65, 91)} | {i: "0" for i in range(48, 58)}
RUNS = re.compile(r"(.)\1+").sub


def tokens(word: str) -> list[int]:
    """Feature numbers of a word: itself without case, and its shape."""
    from xxhash import xxh32_intdigest as h

    shape = RUNS(r"\1+", "".join("a" if ord(c) > 127 and c.islower() else "A" if ord(c) > 127 and c.isupper() else c for c in word.translate(LETTERS)))
    return [h(word.lower(), 1) % DIM, h(shape, 2) % DIM]


def meta_tokens(source, lang, n_chars) -> list[int]:
    from xxhash import xxh32_intdigest as h

    size = int(math.log2(1 + max(0, n_chars or 0)) * 2)
    return [h(x, 3) % DIM for x in (f"s={source}", f"l={lang}", f"n={size}", f"s={source} l={lang}", f"l={lang} n={size}")]


def sparse(rows: list, weights: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, weight); without weights, features of a row weigh the same and sum to 1."""
    n = np.array([len(r) for r in rows])
    row = np.repeat(np.arange(len(rows)), n)
    return row, np.concatenate([np.asarray(r, np.int64) for r in rows]), 1 / n[row] if weights is None else np.concatenate([np.asarray(w, float) for w in weights])


def scores(x, w: np.ndarray, n: int) -> np.ndarray:
    row, feature, weight = x
    return np.bincount(row, w[feature] * weight, n) + w[-1]


def fit(x, y: np.ndarray, n: int, steps: int = 60, rate: float = 2.0, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression by Adagrad over all rows; the last weight is the intercept. Classes weigh the same."""
    row, feature, weight = x
    w, seen = np.zeros(DIM + 1), np.full(DIM + 1, 1e-8)
    balance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(scores(x, w, n), -30, 30)))
        e = (p - y) * balance
        g = np.append(np.bincount(feature, e[row] * weight, DIM), e.sum()) + ridge * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


def calibrate(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic model of the columns of z, by Newton steps with a small ridge."""
    x = np.concatenate((z, np.ones((len(z), 1))), 1)
    b = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(b))
        b -= np.linalg.solve(h, x.T @ (p - y) + 1e-2 * b)
    return b


def take(x, rows: np.ndarray, n: int):
    """The rows of a sparse matrix, renumbered."""
    where = np.full(n, -1)
    where[rows] = np.arange(len(rows))
    ok = where[x[0]] >= 0
    return where[x[0][ok]], x[1][ok], x[2][ok]


def co_train(text: tuple, meta: tuple, y: np.ndarray, fold: np.ndarray, rounds: int = ROUNDS) -> dict:
    """y: 1, 0, or -1 for the pool; fold 0 trains, 1 calibrates, 2 sets the cutoff. Returns weights, calibration and cutoff."""
    n, views = len(y), [text, meta]
    neutral = {"w": [np.zeros(DIM + 1)] * 2, "platt": [np.zeros(2)] * 2, "mix": np.zeros(3), "cutoff": 0.0}
    labelled = (y >= 0) & (fold == 0)
    if len({*y[labelled]}) < 2:
        return neutral
    own = [np.where(labelled, y, -1) for _ in views]
    for k in range(rounds + 1):
        w = []
        for v in (0, 1):
            rows = np.flatnonzero(own[v] >= 0)
            w.append(fit(take(views[v], rows, n), own[v][rows], len(rows)))
        if k == rounds:
            break
        share = float((y[labelled] == 1).mean())
        for v in (0, 1):  # confident labels of one view teach the other
            z = scores(views[v], w[v], n)
            free = np.flatnonzero((y < 0) & (own[1 - v] < 0))
            order, edge = free[np.argsort(z[free], kind="stable")], math.log(CONFIDENT / (1 - CONFIDENT))
            good = [i for i in order[::-1][: max(1, round(GROW * share))] if z[i] >= edge]
            bad = [i for i in order[: max(1, round(GROW * (1 - share)))] if z[i] <= -edge]
            own[1 - v][good], own[1 - v][bad] = 1, 0
    z = np.stack([scores(views[v], w[v], n) for v in (0, 1)], 1)
    held = (y >= 0) & (fold == 1)
    if len({*y[held]}) < 2:
        held = labelled
    platt = [calibrate(z[held][:, [v]], y[held]) for v in (0, 1)]
    odds = np.stack([z[:, v] * platt[v][0] + platt[v][1] for v in (0, 1)], 1)
    mix = calibrate(odds[held], y[held])
    last = (y == 1) & ((fold == 2) if ((fold == 2) & (y == 1)).any() else held)
    p = 1 / (1 + np.exp(-np.clip(odds @ mix[:2] + mix[2], -30, 30)))
    return {"w": w, "platt": platt, "mix": mix, "cutoff": min(0.5, float(np.quantile(p[last], FALSE_REJECTION, method="lower")))}


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", pool_size: int = POOL) -> dict:
    order = F.xxhash64("id")
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").cast("int").alias("y"))
    some = known.orderBy(order, "id").limit(LABELLED)
    pool = docs.select(F.col(f"`{key}`").cast("long").alias("id")).where("id IS NOT NULL").join(known, "id", "left_anti").orderBy(order, "id").limit(pool_size).distinct()
    # at most LABELLED + POOL rows of two numbers
    ids = F.broadcast(some.union(pool.select("id", F.lit(-1))))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{source}`").cast("string").alias("s"), F.col(f"`{lang}`").cast("string").alias("l"), F.col(f"`{n_chars}`").cast("long").alias("n")).join(ids, "id")
    # of rows with one id, one is taken: an id may be repeated any number of times
    rows = rows.groupBy("id", "y").agg(F.min(F.struct("t", "s", "l", "n")).alias("r")).select("id", "r.t", "r.s", "r.l", "r.n", "y")

    def run(batches):
        for b in batches:
            texts = [Counter(f for w in (t or "").split() for f in tokens(w)) for t in b.column(1).to_pylist()]
            meta = [meta_tokens(*x) for x in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(5), *(pa.array([np.array([*f], k).tobytes() for f in x], pa.binary()) for x, k in ((texts, np.int32), ([t.values() for t in texts], np.float32), (meta, np.int32)))], names=["id", "y", "text", "counts", "meta"])

    got = sorted(rows.mapInArrow(run, "id long, y int, text binary, counts binary, meta binary").toLocalIterator(), key=lambda r: (r["id"], r["text"]))
    from xxhash import xxh32_intdigest as h

    fold = np.array([(0, 0, 0, 1, 2)[h(str(r["id"]), 4) % 5] for r in got])
    if not got:
        return co_train((), (), np.zeros(0, int), fold) | {"used": []}
    counts = [np.frombuffer(r["counts"], np.float32) for r in got]
    text_view = sparse([np.frombuffer(r["text"], np.int32) for r in got], [2 * c / max(1, c.sum()) for c in counts])
    y = np.array([r["y"] for r in got])
    used = sorted({r["id"] for r, ok in zip(got, (y >= 0) & (fold < 2), strict=True) if ok})
    return co_train(text_view, sparse([np.frombuffer(r["meta"], np.int32) for r in got]), y, fold) | {"used": used}


BINS = 1 << 12


def low_quantile(values: DataFrame, share: float) -> float | None:
    """The share quantile (method lower) of column score, within 0 and 1, to 2^-48; each round looks into one of BINS bins."""
    values = stored(values.select("score"), "scores")
    n = values.count()
    if not n:
        return None
    rank, low, width = math.floor(share * (n - 1)), 0.0, 1.0
    for _ in range(4):
        width /= BINS
        within = F.least(F.floor((F.col("score") - low) / width), F.lit(BINS - 1)).alias("bin")
        for r in sorted(values.groupBy(within).agg(F.count("*").alias("c")).collect()):
            if rank < r.c:
                break
            rank -= r.c
        values, low = values.where(within == r.bin), low + r.bin * width
    return values.agg(F.min("score")).first()[0]


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", pool_size: int = POOL) -> DataFrame:
    """``doc_id, p_text, p_meta, score, kept`` for every row of docs."""
    names = (key, text, source, lang, n_chars)
    model = train(docs, labels, *names, pool_size)
    used = model.pop("used")
    out = scored(docs, model, *names)
    if used:
        good = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("y")).where("y = 1")
        # at most LABELLED ids
        good = good.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in used], "id long")), "id", "left_anti")
        out = stored(out, "scored")
        cutoff = low_quantile(out.join(good, out["doc_id"] == good["id"], "left_semi"), FALSE_REJECTION)
        cutoff = model["cutoff"] if cutoff is None else min(0.5, cutoff)
        out = out.withColumn("kept", F.col("score") >= cutoff)
    return out


def scored(docs: DataFrame, model: dict, key: str, text: str, source: str, lang: str, n_chars: str) -> DataFrame:
    """The columns of classify for every row of docs, by a model of train."""
    model = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`").cast("string"), F.col(f"`{source}`").cast("string"), F.col(f"`{lang}`").cast("string"), F.col(f"`{n_chars}`").cast("long"))

    def run(batches):
        m, known = model.value, {}
        w, wm = m["w"]

        def weigh(word):
            got = float(w[tokens(word)].sum())
            if len(word) <= 64:
                if len(known) > 150_000:
                    known.clear()
                known[word] = got
            return got

        for b in batches:
            z = np.zeros((b.num_rows, 2))
            for i, (t, s, l, n) in enumerate(zip(*(b.column(k) for k in (1, 2, 3, 4)), strict=True)):
                words = (t.as_py() or "").split()
                z[i, 0] = sum([known.get(x) or weigh(x) for x in words]) / max(1, len(words)) + w[-1]
                z[i, 1] = wm[meta_tokens(s.as_py(), l.as_py(), n.as_py())].mean() + wm[-1]
            odds = np.stack([z[:, v] * m["platt"][v][0] + m["platt"][v][1] for v in (0, 1)], 1)
            both = np.stack((odds[:, 0], odds[:, 1], odds @ m["mix"][:2] + m["mix"][2]), 1)
            p = 1 / (1 + np.exp(-np.clip(both, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, k]) for k in (0, 1, 2)), pa.array(p[:, 2] >= m["cutoff"])], names=["doc_id", "p_text", "p_meta", "score", "kept"])

    return rows.mapInArrow(run, "doc_id long, p_text double, p_meta double, score double, kept boolean")
