"""Lexical and vector search, search by a row, and average vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.storage import shared_path


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def matches(df: DataFrame, key: str, text: str, q: str) -> DataFrame:
    """``key, score`` of every row that holds a word of q: summed tf * idf over the rows of df.

    Only rows that hold a word are exploded. Their counts are written down, as they are wanted twice: texts are cut once. The
    counts by word are a table of a few rows.
    """
    words = sorted({w for w in "".join(c.lower() if c.isalnum() else " " for c in q).split()})
    n_docs = df.agg(F.count("*").alias("n_docs"))
    wanted = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    hits = df.select(F.col(key).alias("key"), F.explode(F.filter(terms(F.col(text)), lambda w: F.array_contains(wanted, w))).alias("word"))
    path = shared_path(df.sparkSession, "terms")
    hits.groupBy("key", "word").agg(F.count("*").alias("tf")).write.parquet(path)
    tf = df.sparkSession.read.parquet(path)
    dfreq = tf.groupBy("word").agg(F.count("*").alias("df"))  # at most a row for each word of q
    scored = tf.join(F.broadcast(dfreq), "word").join(F.broadcast(n_docs))
    ranked = scored.groupBy("key").agg(F.sum(F.col("tf") * F.log(1 + F.col("n_docs") / F.col("df"))).alias("score"))
    return ranked.select(F.col("key").alias(key), F.round("score", 6).alias("score"))


def lexical(df: DataFrame, key: str, text: str, q: str, limit: int = 10, offset: int = 0, where: Column | None = None) -> DataFrame:
    """The best rows for the words of q; ties go to the smaller key. ``where`` filters the rows that are searched."""
    return matches(df if where is None else df.where(where), key, text, q).orderBy(F.col("score").desc(), key).offset(offset).limit(limit)


def total_matches(df: DataFrame, key: str, text: str, q: str, where: Column | None = None) -> int:
    """The number of rows that a lexical search finds, on all pages."""
    return matches(df if where is None else df.where(where), key, text, q).count()


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def semantic(df: DataFrame, key: str, vector: str, query: list[float], limit: int = 10, where: Column | None = None) -> DataFrame:
    """The nearest rows by cosine: one pass and a top-k. ``where`` filters the rows that are searched."""
    df = df if where is None else df.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.select(key, F.round(cosine(F.col(vector), q), 6).alias("rank")).orderBy(F.col("rank").desc(), key).limit(limit)


def by_resource(df: DataFrame, key: str, vector: str, resource, limit: int = 10, include: bool = False) -> DataFrame:
    """The rows nearest to one row; the row itself has rank 1 and is left out unless asked for."""
    own = df.where(F.col(key) == resource).select(F.col(vector).alias("__q")).limit(1)
    rows = df if include else df.where(F.col(key) != resource)
    return rows.join(F.broadcast(own)).select(key, F.round(cosine(F.col(vector), F.col("__q")), 6).alias("rank")).orderBy(F.col("rank").desc(), key).limit(limit)


def average_vectors(df: DataFrame, by: str, vector: str) -> DataFrame:
    """The mean vector of each group; means are aggregated before the shuffle, by component."""
    parts = df.select(by, F.posexplode(vector).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("vector"))
