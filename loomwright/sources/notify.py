"""Notification sinks: messages from templates, sent by a given transport, with a status for each."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUS = "id string, success boolean, error string"


def render(template: str) -> Column:
    """A template's text; ``{{name}}`` is the column of that name, empty where it is null."""
    parts = re.split(r"\{\{\s*(\w+)\s*\}\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(F.col(f"`{p}`").cast("string"), F.lit("")) for i, p in enumerate(parts)])


def send(messages: DataFrame, transport: Callable[[list[dict]], Iterable[str | None]], batch: int = 100) -> DataFrame:
    """Statuses of messages (``id`` and what the transport reads): the transport gets up to ``batch`` at once and gives an error or None for each.

    A batch that raises fails as a whole and the others go on. Tasks that run again send again: delivery is at least once,
    so transports should drop ids that they know.
    """

    def run(batches):
        for some in batches:
            for at in range(0, some.num_rows, batch):
                rows = some.slice(at, batch).to_pylist()
                try:
                    errors = list(transport(rows))
                    if len(errors) != len(rows):
                        raise ValueError(f"{len(errors)} statuses for {len(rows)} messages")
                except Exception as e:  # noqa: BLE001 -- whatever a transport raises is the status
                    errors = [f"{type(e).__name__}: {e}"] * len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([r["id"] for r in rows], pa.string()), pa.array([e is None for e in errors], pa.bool_()), pa.array(errors, pa.string())], names=["id", "success", "error"])

    return messages.withColumn("id", F.col("id").cast("string")).mapInArrow(run, STATUS)


def on_batches(transport: Callable[[list[dict]], Iterable[str | None]], path: str):
    """For ``foreachBatch``: sends a micro-batch and writes its statuses below path, in a folder of the batch."""
    return lambda df, n: send(df, transport).write.mode("overwrite").json(f"{path}/batch={n}")
