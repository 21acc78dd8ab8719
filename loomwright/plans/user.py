"""User actions in flows: an iteration waits until the values of its prompt are supplied.

Blocking isn't Spark's way, so a run joins the iterations with the table of answers and says which still wait; the next run,
with more answers, goes on from there. Both sides are shuffled by prompt; neither is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prompt_id(node: str, *seq: str) -> Column:
    """The uid of the prompt of a node in an iteration; an answer must name it."""
    return F.sha2(F.concat_ws("/", F.lit(node), *[F.col(c).cast("string") for c in seq]), 256)


def resolve(iterations: DataFrame, answers: DataFrame, node: str, seq: list[str], order: str) -> DataFrame:
    """iterations with ``user_values`` and ``user_status`` (answered or waiting).

    ``answers`` has ``uid``, ``values`` and the column named by ``order``; the latest answer of a prompt counts.
    """
    latest = answers.where("uid IS NOT NULL").groupBy("uid").agg(F.max_by("values", order).alias("user_values"), F.lit(True).alias("_answered"))
    out = iterations.withColumn("_uid", prompt_id(node, *seq)).join(latest.withColumnRenamed("uid", "_uid"), "_uid", "left")
    return out.withColumn("user_status", F.when(F.col("_answered"), "answered").otherwise("waiting")).drop("_uid", "_answered")


def unasked(iterations: DataFrame, answers: DataFrame, node: str, seq: list[str]) -> DataFrame:
    """Answers that no prompt asked for; they are errors of whoever sent them."""
    return answers.join(iterations.select(prompt_id(node, *seq).alias("uid")), "uid", "left_anti")
