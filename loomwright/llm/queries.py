"""One query for each training-data operator, over its whole table, and the oracle SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import bpe_automaton, cotraining, line_chunks, mixing, order_minhash, perspective, quality_rules, repair_binary, token_fst, vptree
from loomwright.llm.base import shared_dir, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = quality_rules.judge(docs, table(spark, sf_dir, "labels"), carry=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_removed_chunks", "n_removed_lines")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_fst.token_counts(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mixing.plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    shards = F.array_join(F.transform("shards", lambda s: s.cast("string")), ",")
    return p.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), shards.alias("mix_shards"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op8_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    repair_binary.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return repair_binary.read_ids(spark, path).select(F.col("key").alias("doc_id"), "start", "n_tokens", F.col("crc32").alias("ids_crc32"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe_automaton.encode(docs, public_tokenizers.path("word_bpe_49k.json"), carry=["doc_id"])
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perspective.rotate(table(spark, sf_dir, "conversations"))
    masks = F.array_join(F.transform("masks", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return out.select("conv_id", "segment", "speaker", "n_turns", "rendered", masks.alias("masks"), "n_trained")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_quality_classifier, op3_near_dedup, op4_line_dedup, op5_token_counts, op6_mixing, op7_nearest, op8_binary_output, op9_bpe, op10_perspectives, pipeline)}
