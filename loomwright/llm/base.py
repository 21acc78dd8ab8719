"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; only where that is unset and the master is local, a folder of this process."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="loomwright-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Lists of the paths that ``stored`` writes to, innermost last; see ``recorded``.
RECORDS: list[list[str]] = []


@contextmanager
def recorded():
    """The paths of all tables that are stored meanwhile."""
    RECORDS.append([])
    try:
        yield RECORDS[-1]
    finally:
        RECORDS.pop()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in RECORDS:
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete stored tables (or their paths) that nothing reads any more."""
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that start with the stems and clash with none of df's columns (Spark compares without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = f"_{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(rows: DataFrame, group: str, *order, place: str = "place", sums: dict[str, str] | None = None) -> DataFrame:
    """rows with ``place``, the number of each within its group from 0 in the order given, and running sums (name -> column).

    Rows are dealt by ranges of group and order and numbered inside of each range; the numbers and sums of a group's ranges
    before are added. So no task sorts or sums a whole group, however many of the rows it holds. Rows that agree in all of
    the order are interchangeable.
    """
    sums = sums or {}
    tie, part, at, g, r, shift, *before = fresh(rows, "tie", "part", "at", "g", "r", "shift", *[f"before{i}" for i in range(len(sums))])
    spread = [F.col(group), *order, F.col(tie)]
    ranged = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*spread).sortWithinPartitions(*spread).drop(tie)
    ranged = stored(ranged.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}), "ranged")
    firsts = ranged.groupBy(group, part).agg(F.min(at).alias("first"), F.count("*").alias("n"), *[F.sum(c).alias(b) for c, b in zip(sums.values(), before, strict=True)])
    earlier = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    firsts = firsts.select(F.col(group).alias(g), F.col(part).alias(r), (total("n") - F.col("first")).alias(shift), *[total(b).alias(b) for b in before])
    if sums:
        inner = Window.partitionBy(part, group).orderBy(at)
        ranged = ranged.withColumns({name: F.sum(c).over(inner) for name, c in sums.items()})
    out = ranged.join(firsts, F.col(group).eqNullSafe(F.col(g)) & (F.col(part) == F.col(r)))
    return out.withColumns({place: F.col(at) + F.col(shift), **{name: F.col(name) + F.col(b) for name, b in zip(sums, before, strict=True)}}).drop(g, r, shift, part, at, *before)
