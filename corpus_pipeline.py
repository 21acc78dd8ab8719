"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing and BPE encoding, each stage over all that the one before kept.

A stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again for the next. All but the last return the columns of documents. What a stage stored on its way is deleted
when the next one begins, as its result is written by then.
"""

from __future__ import annotations

import uuid
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import bpe_automaton, line_chunks, mixing, order_minhash, quality_rules
from loomwright.llm.base import WORD, dropped, recorded, shared_dir, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS[:-1], F.length("text").cast("long").alias("n_chars"))


#: Most rows of a batch that goes to a Python worker: at Spark's 10,000, whole batches of texts are held on both sides.
BATCH, BATCH_CONF = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Paths that the last stage of each application stored, by its id.
SCRATCH: dict[str, list[str]] = {}


def stage(function):
    """A stage that cleans up after the one before it, unless its documents are still read from there.

    The session's batches for Python workers have BATCH rows at most from then on, as a stage's result is lazy.
    """

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rows = int(spark.conf.get(BATCH_CONF))
        spark.conf.set(BATCH_CONF, str(min(rows, BATCH) if rows > 0 else BATCH))
        app = spark.sparkContext.applicationId
        if old := SCRATCH.pop(app, None):
            read = docs.inputFiles()
            dropped(spark, *[p for p in old if not any(p.rpartition("/")[2] in f for f in read)])
        with recorded() as paths:
            out = function(spark, docs, sf_dir)
        SCRATCH[app] = paths
        return out

    return run


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return _columns(quality_rules.judge(docs, table(spark, sf_dir, "labels")).where("kept"))


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go; documents stay, with what is left."""
    return _columns(line_chunks.dedup_lines(docs))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: that with the least id, ids before null ids; of rows with one text, one.

    Rows are told apart by numbers of their own, so documents that share an id, or have none, are judged by their texts.
    Texts without words have no class: of such rows with one id and text one stays, and all without an id.
    """
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    row = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "lang", "source")).alias("o")
    kept = ["o.doc_id", "text", "o.lang", "o.source"]
    once = docs.where(worded).groupBy("text").agg(row).select(*kept)
    bare = docs.where(~worded & F.col("doc_id").isNotNull()).groupBy("doc_id", "text").agg(row).select(*kept)
    once = once.union(bare).union(docs.where(~worded & F.col("doc_id").isNull()).select("doc_id", "text", "lang", "source"))
    once = stored(once.withColumn("row", F.monotonically_increasing_id()), "once")
    classes = order_minhash.near_duplicates(once, key="row").select(F.col("doc_id").alias("row"), "class_id")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("digest"), "row")
    first = once.select("row", rank.alias("rank")).join(classes, "row").groupBy("class_id").agg(F.min("rank").alias("rank")).select("rank.row")
    return _columns(once.join(first, "row", "left_semi"))


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes; rows of one output shard are written together, in the shard's order."""
    return _columns(mixing.mix(docs).repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_place"))


@stage
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text that they decode to."""
    out = bpe_automaton.encode(docs, public_tokenizers.path("word_bpe_49k.json"), carry=["doc_id", "source"])
    return out.select("doc_id", "source", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near_duplicates), ("mixing", mixture), ("BPE", encoded)]

#: SQL can't express the merges of near-dedup and BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        path = f"{shared_dir(spark)}/stage-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
