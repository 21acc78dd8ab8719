"""Operator 10: multi-party chat formatting by perspective rotation.

For every participant (a speaker other than ``system``) of a conversation, the whole dialogue is rendered with that speaker
as the assistant, all others as named users, and a mask of what is trained on: the assistant's words and the end mark after
them. System turns keep their role in every perspective and are never trained on.

A rendering is stored in pieces of SEGMENT turns: ``segment`` numbers them, and a participant has one for each segment of the
conversation, whether they speak in it or not, so that the pieces in order, put together, are the dialogue as it would be
rendered at once. Masks count from their piece's start.

Turns are in the order of turn, then speaker, then text. They are dealt by ranges of that order, numbered inside of each, and
the numbers of the ranges before are added: a conversation that holds a third of all rows is sorted and numbered in many
tasks, and no more than SEGMENT turns are gathered. Rows grow with turns times participants, as the perspectives do.
Everything is DataFrame functions.

Marks inside of texts and names do not open a turn: ``<|`` is written ``<\\|`` there, and ``|>`` in names ``|\\>``.

Results by case: a null text is rendered as empty; a null speaker is named ``unknown`` and takes part; null turns come
first; repeated rows are separate turns; a conversation of system turns alone has no perspective and no row; a null
conversation id is a conversation of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.base import numbered

SEGMENT = 64
#: Marks of the rendering.
OPEN, CLOSE, END = "<|", "|>", "<|end|>"


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """``conv_id, segment, speaker, n_turns, rendered, masks`` (array of [start, end) code points that are trained on), ``n_trained``."""
    rows = turns.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{speaker}`").cast("string"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    rows = numbered(rows, "conv_id", F.col("turn").asc_nulls_first(), F.col("speaker"), F.col("text"))
    rows = rows.withColumns({"segment": F.floor(F.col("place") / segment).cast("long"), "text": F.replace("text", F.lit(OPEN), F.lit("<\\|"))})
    parts = rows.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(F.struct("place", "speaker", "text"))).alias("turns"))
    who = rows.where("speaker <> 'system'").select(F.col("conv_id").alias("c"), "speaker").distinct()
    seen = parts.join(who, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    named = lambda s: F.replace(F.replace(s, F.lit(OPEN), F.lit("<\\|")), F.lit(CLOSE), F.lit("|\\>"))
    head = lambda t: F.when(t["speaker"] == F.col("speaker"), F.lit(f"{OPEN}assistant{CLOSE}")).when(t["speaker"] == "system", F.lit(f"{OPEN}system{CLOSE}")).otherwise(F.concat(F.lit(f"{OPEN}user:"), named(t["speaker"]), F.lit(CLOSE)))
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), (t["speaker"] == F.col("speaker")).alias("own")))
    seen = seen.withColumn("pieces", pieces)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc, p):
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        return F.struct(end.cast("long").alias("at"), F.when(p["own"], F.concat(acc["spans"], F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"))))).otherwise(acc["spans"]).alias("spans"))

    seen = seen.withColumn("masks", F.aggregate("pieces", start, step)["spans"])
    rendered = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "")
    trained = F.aggregate("masks", F.lit(0).cast("long"), lambda a, m: a + m["end"] - m["start"])
    return seen.select("conv_id", "segment", "speaker", F.size("turns").cast("long").alias("n_turns"), rendered.alias("rendered"), "masks", trained.alias("n_trained"))
