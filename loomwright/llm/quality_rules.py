"""Operator 1: quality rules with risk-controlled thresholds. DataFrame functions only.

Base counts come from whole texts. Each rule compares a ratio, in thousandths, with a cutoff that is selected for its
stratum (language) on the labelled holdout: documents labelled good that pass the base test. For a cutoff c, k of n good
documents would be rejected; c is safe if a binomial variable with n trials and the rule's rate is at most k with a chance of
at most the level, that is if the exact (Clopper-Pearson) upper bound of the false rejection rate is below that rate.
The cutoffs of one rule are tested from the loosest on and testing stops at the first failure, so they share one level;
rules and strata divide ``delta`` (Bonferroni), and the rules of a stratum divide ``risk``. A rule without a safe cutoff in a
stratum rejects nothing there. With probability 1 - delta over the labels, the rules together then reject at most ``risk``
of the good documents of every stratum that pass the base test. Each text counts once in the holdout, as equal ones are
no independent trials.

Results by case: null and wordless texts have counts of 0 and fail the base test; a null stratum is a stratum of its own;
documents without labels don't matter for cutoffs, a document with several labels is good only if all of them are;
repeated rows get equal results; an empty table gives an empty result;
a tie with a cutoff is kept; extra columns stay, clashing ones are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.base import SPACE, fresh, stored

#: Rules: name -> (count column, column it is divided by).
RULES = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "capitals": ("n_capitals", "word_chars")}
GRID = (5, 10, 15, 20, 30, 40, 50, 75, 100, 150, 200, 300, 400, 500, 600, 700, 800, 900)
RISK, DELTA = 0.02, 0.05
COUNTS = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words")


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with COUNTS (long) and ``base_failed``.

    Windows of three words are compared by a 64-bit hash. Only texts that hold a repeated window sort theirs.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {*COUNTS, "base_failed"}])
    keep = [F.col(f"`{c}`") for c in docs.columns]
    t, w, lines, h, order, at = fresh(docs, "t", "w", "lines", "h", "order", "at")
    body = F.btrim(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    df = docs.select(*keep, body.alias(t))
    words = F.when(F.col(t) == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE))
    with_word = F.filter(F.split(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(*keep, t, words.alias(w), with_word.alias(lines))
    n = F.size(w)
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    long = lambda c: c.cast("long")
    df = df.select(
        *keep, long(n).alias("n_words"), long(F.length(F.array_join(w, ""))).alias("word_chars"), long(F.regexp_count(t, F.lit(r"[#*$%&|<>]"))).alias("n_symbols"), long(F.regexp_count(t, F.lit("[A-Z]"))).alias("n_capitals"),
        long(F.size(lines)).alias("n_lines"), long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"), hashes.alias(h),
    )
    counts = [F.col(c) for c in COUNTS[:-1]]
    sorted_ = F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).otherwise(F.array().cast("array<struct<x:bigint,i:int>>"))
    df = df.select(*keep, *counts, sorted_.alias(order))
    twice = F.transform(order, lambda e, k: F.when((F.get(order, k - 1)["x"] == e["x"]) | (F.get(order, k + 1)["x"] == e["x"]), e["i"]))
    df = df.select(*keep, *counts, F.array_sort(F.filter(twice, lambda i: i.isNotNull())).alias(at))
    covered = F.aggregate(at, F.struct(F.lit(-9).alias("last"), F.lit(0).alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")))["n"]
    df = df.select(*keep, *counts, long(covered).alias("n_repeat_words"))
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def permille(rule: str) -> Column:
    top, below = RULES[rule]
    return F.floor(1000 * F.col(top) / F.greatest(F.col(below), F.lit(1)))


def log_factorial(n: Column) -> Column:
    """ln n! to double precision: exact below 16, Stirling's series above."""
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5)))
    return F.when(n < 16, F.log(F.factorial(F.least(n, F.lit(16)).cast("int")))).otherwise(series)


def at_most(k: Column, n: Column, rate: float) -> Column:
    """P(Bin(n, rate) <= k) for k below the mean, else 1; terms further than 40 standard deviations from k are below any double."""
    first = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(rate) + (n - k) * math.log1p(-rate))
    reach = F.ceil(40 * F.sqrt(n * rate) + 100)
    odds = (1 - rate) / rate
    start = F.struct(first.alias("term"), first.alias("sum"))

    def step(a, i):
        term = a["term"] * i / (n - i + 1) * odds
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    down = F.when(k > 0, F.sequence(k, F.greatest(F.lit(1).cast("long"), k - reach), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(k < n * rate, F.aggregate(down, start, step)["sum"]).otherwise(1.0)


def select_cutoffs(holdout: DataFrame, stratum: str, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``stratum, c_<rule>...`` (null: no safe cutoff) from good documents that pass the base test."""
    counts = stored(holdout.groupBy(F.col(f"`{stratum}`").alias("stratum")).agg(F.count("*").alias("n"), *[F.count_if(permille(r) > c).alias(f"k_{r}_{c}") for r in RULES for c in GRID]), "strata")
    tests = counts.select("stratum", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"k_{r}_{c}").alias("k")) for r in RULES for c in GRID])).alias("t")).select("stratum", "n", "t.*")
    level = delta / (max(1, counts.count()) * len(RULES))
    loosest = Window.partitionBy("stratum", "rule").orderBy(F.col("cutoff").desc())
    tests = tests.withColumn("failed", F.max((at_most(F.col("k"), F.col("n"), risk / len(RULES)) > level).cast("int")).over(loosest))
    return tests.groupBy("stratum").agg(*[F.min(F.when((F.col("rule") == r) & (F.col("failed") == 0), F.col("cutoff"))).alias(f"c_{r}") for r in RULES])


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", risk: float = RISK, delta: float = DELTA, carry: bool = True) -> DataFrame:
    """docs (without carry: its key alone) with COUNTS, ``base_failed`` and ``kept``.

    Counts are made once and written with the rows, so the verdicts need neither the texts again nor a shuffle.
    """
    names = {*COUNTS, "base_failed", "kept"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in names])
    s, x, at, *cuts = fresh(docs, "stratum", "digest", "at", *RULES)
    lang, digest = F.col(f"`{stratum}`").cast("string").alias(s), F.xxhash64(F.col(f"`{text}`").cast("string")).alias(x)
    counted = base_counts(docs.select(*[F.col(f"`{c}`") for c in docs.columns], lang, digest), text)
    if not carry:
        counted = counted.select(F.col(f"`{key}`"), s, x, *COUNTS, "base_failed")
    counted = stored(counted, "counts")
    good = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("label")).agg(F.min("quality").alias("quality")).where("quality = 1")
    holdout = counted.where(~F.col("base_failed")).select(F.col(f"`{key}`").alias("key"), F.col(s).alias("stratum"), F.col(x).alias("digest"), *COUNTS).join(good, F.col("key") == F.col("label"), "left_semi")
    cutoffs = stored(select_cutoffs(holdout.dropDuplicates(["stratum", "digest", *COUNTS]), "stratum", risk, delta), "cutoffs")
    near = cutoffs.select(F.col("stratum").alias(at), *[F.col(f"c_{r}").alias(c) for r, c in zip(RULES, cuts, strict=True)])
    out = counted.join(F.broadcast(near) if cutoffs.count() <= 10_000 else near, F.col(s).eqNullSafe(F.col(at)), "left")
    kept = ~F.col("base_failed")
    for r, c in zip(RULES, cuts, strict=True):
        kept = kept & F.coalesce(permille(r) <= F.col(c), F.lit(True))
    return out.withColumn("kept", kept).drop(at, s, x, *cuts)
