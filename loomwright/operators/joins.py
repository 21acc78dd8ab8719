"""Joins that Spark has no operator for: as-of joins and joins of points with intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: str, left_at: str, right_at: str, width: int, values: list[str]) -> DataFrame:
    """Each left row with ``values`` of the last right row of its key at or before it, null if there is none.

    Times are whole numbers or become such (``bigint``). A key's time is cut into spans of ``width``: a span starts from the
    last right row of the spans before it, so a hot key is sorted span by span, and only one row for each span of a key
    meets the spans' own window.
    """
    t, span = "__t", "__span"
    cols = [F.col(f"`{v}`") for v in values]
    l = left.withColumn(t, F.col(left_at).cast("bigint")).withColumn(span, F.floor(F.col(t) / width)).withColumn("__side", F.lit(1))
    r = right.select(F.col(by), F.col(right_at).cast("bigint").alias(t), F.struct(*cols).alias("__v")).withColumn(span, F.floor(F.col(t) / width)).withColumn("__side", F.lit(0))
    ends = r.groupBy(by, span).agg(F.max_by("__v", F.struct(t, "__v")).alias("__v"))
    spans = l.select(by, span).distinct().join(ends, [by, span], "full")
    before = Window.partitionBy(by).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.withColumn("__v", F.last("__v", ignorenulls=True).over(before)).where("__v IS NOT NULL")
    starts = starts.select(by, (F.col(span) * width).alias(t), "__v", span, F.lit(-1).alias("__side"))
    rows = l.unionByName(r, allowMissingColumns=True).unionByName(starts, allowMissingColumns=True)
    last = Window.partitionBy(by, span).orderBy(t, "__side", F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("__v", F.last("__v", ignorenulls=True).over(last)).where("__side = 1")
    return out.select(*[F.col(f"`{c}`") for c in left.columns], *[F.col("__v").getField(v).alias(v) for v in values])


def in_interval(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs of points and the intervals [low, high) that hold them. Both are dealt into buckets of ``width``, so it is an equi join.

    An interval is repeated for each bucket that it meets; a point lies in one, so no pair comes twice.
    """
    bucket = lambda c: F.floor(c / width)
    wide = intervals.where(F.col(low) < F.col(high)).withColumn("__b", F.explode(F.sequence(bucket(F.col(low)), bucket(F.col(high)))))
    pairs = points.withColumn("__b", bucket(F.col(at))).join(wide, "__b").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high)))
    return pairs.drop("__b")
