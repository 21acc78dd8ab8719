"""Structured Streaming: sources, windows, gates, replication and change feeds; and their batch forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.storage import shared_path

ACTIONS = ("CREATE", "UPDATE", "DELETE", "WRITE", "READ", "VIEW")


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A Parquet file source with the schema of what is there; a trigger takes so many files at most.

    A path that is one file is streamed as the folder around it, with the file's name as filter.
    """
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def drain(stream: DataFrame, label: str = "stream", mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, into Parquet of the shared folder, and read it. Exactly once by the file sink's log."""
    spark = stream.sparkSession
    out, state = shared_path(spark, label), shared_path(spark, f"{label}-state")
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_complete(stream: DataFrame, label: str = "stream") -> DataFrame:
    """As drain, for a complete-mode aggregate: the last batch replaces the ones before it."""
    spark = stream.sparkSession
    out, state = shared_path(spark, label), shared_path(spark, f"{label}-state")
    # a batch has a folder of its own: one that fails halfway leaves the result before it whole
    done = []

    def keep(df, n):
        df.write.mode("overwrite").parquet(f"{out}/{n}")
        done.append(n)

    q = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/{max(done)}") if done else spark.createDataFrame([], stream.schema)


def ticker(spark: SparkSession, start: str, end: str, every: str, value: Column | None = None) -> DataFrame:
    """Batch form of a ticker: the times from start on, or a value at each."""
    times = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), F.expr(f"interval {every}"))).alias("tick"))
    return times if value is None else times.select("tick", value.alias("value"))


def ticker_stream(spark: SparkSession, per_second: int = 1) -> DataFrame:
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load()


def windowed_counts(events: DataFrame, ts: str, width: str, by: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts by tumbling, or sliding, event-time window with a watermark: rows later than that are dropped in append mode."""
    e = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return e.groupBy(F.window("__ts", width, slide).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def session_counts(events: DataFrame, ts: str, gap: str, by: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of each key: events with less than the gap between them; start, end (last event and gap) and number."""
    e = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return e.groupBy(by, F.session_window("__ts", gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def interval_join(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, within: str, late: str = "10 minutes") -> DataFrame:
    """Pairs of a key's events of which the right one is at most ``within`` later. On streams, the watermarks bound what is kept.

    Columns of both sides must differ, but for the key.
    """
    l = left.withColumn(left_ts, F.col(left_ts).cast("timestamp"))
    r = right.withColumn(right_ts, F.col(right_ts).cast("timestamp")).withColumnRenamed(by, "__by")
    if left.isStreaming:
        l, r = l.withWatermark(left_ts, late), r.withWatermark(right_ts, late)
    near = (F.col(by) == F.col("__by")) & (F.col(right_ts) >= F.col(left_ts)) & (F.col(right_ts) <= F.col(left_ts) + F.expr(f"interval {within}"))
    return l.join(r, near).drop("__by")


def pull(spark: SparkSession, fetch, path: str, every: float = 0.0, continue_on_error: bool = False, most: int | None = None, wait=None) -> int:
    """Poll a source: fetch() gives a DataFrame of events, or None; each is appended to path as JSON. Returns the polls that gave some.

    The first poll must succeed. After that an error ends the loop, or is passed over with ``continue_on_error``; EOFError
    always ends it, without an error; empty polls are skipped. ``most`` polls are made at most.
    """
    import time

    given, n = 0, 0
    while most is None or n < most:
        try:
            events = fetch()
        except EOFError:
            if not n:
                raise
            break
        except Exception:
            if not (n and continue_on_error):
                raise
            events = None
        if events is not None and not events.isEmpty():
            events.write.mode("append").json(path)
            given += 1
        n += 1
        (wait or time.sleep)(every)
    return given


def dedup(events: DataFrame, keys: list[str], ts: str, within: str = "1 hour") -> DataFrame:
    """First event of each key within the watermark, so that state is bounded."""
    e = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", within)
    return e.dropDuplicatesWithinWatermark(keys).drop("__ts") if events.isStreaming else e.dropDuplicates(keys).drop("__ts")


def gate(events: DataFrame, by: list[str], order: list[str], start: Column, stop: Column | None = None) -> DataFrame:
    """Rows from the first true start on and before the first true stop; stop is looked at first."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stopped = F.max(F.coalesce(stop, F.lit(False))).over(w) if stop is not None else F.lit(False)
    started = F.max(F.coalesce(start, F.lit(False)) & ~(F.coalesce(stop, F.lit(False)) if stop is not None else F.lit(False))).over(w)
    return events.withColumn("__open", started & ~stopped).where("__open").drop("__open")


def latest_by_key(changes: DataFrame, keys: list[str], order: list[str], action: str | None = None) -> DataFrame:
    """The last change of each key, without deleted ones. The greatest row is an aggregate, so a hot key is combined early."""
    rest = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")).select(*keys, "__last.*")
    return last if action is None else last.where(F.col(action) != "DELETE")


def envelope(events: DataFrame, source: Column, event: Column, payload: Column, action: Column) -> DataFrame:
    """Event envelopes; an unknown action is an error."""
    ok = F.when(action.isin(*ACTIONS), action).otherwise(F.raise_error(F.lit("unknown action")).cast("string"))
    return events.select(source.alias("event_source"), event.alias("event"), payload.alias("payload"), ok.alias("action"))


def replicate(spark: SparkSession, source: str, label: str = "sync") -> DataFrame:
    """Copy a table of files into a new destination with a stream that takes what is there, and return the destination."""
    return drain(file_stream(spark, source), label)


def change_feed(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``key, action`` of what differs between two states: CREATE, UPDATE or DELETE.

    Rows are compared by a hash of their values and of which are null (a hash of values alone passes over nulls). Null keys
    are one key.
    """
    state = lambda df, k, h: df.select(F.col(f"`{key}`").alias(k), F.xxhash64(*[x for c in before.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]).alias(h))
    both = state(before, "k", "ha").join(state(after, "j", "hb"), F.col("k").eqNullSafe(F.col("j")), "full")
    action = F.when(F.col("ha").isNull(), "CREATE").when(F.col("hb").isNull(), "DELETE").when(F.col("ha") != F.col("hb"), "UPDATE")
    return both.select(F.coalesce("k", "j").alias(key), action.alias("action")).where("action IS NOT NULL")


def stateful_gate(events: DataFrame, by: str, start, schema: str):
    """Streaming start gate by key with applyInPandasWithState; start(pdf) gives a boolean Series. State is one flag a key."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, frames, state):
        import pandas as pd

        open_ = state.exists and state.get[0]
        for pdf in frames:
            if not open_:
                on = start(pdf)
                open_ = bool(on.any())
                pdf = pdf[on.cummax()] if open_ else pdf.iloc[:0]
            yield pdf if isinstance(pdf, pd.DataFrame) else pd.DataFrame(pdf)
        state.update((open_,))

    return events.groupBy(by).applyInPandasWithState(run, schema, "open boolean", "append", GroupStateTimeout.NoTimeout)
