"""Row, line, blob and feature sinks, table definitions, and column codecs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.sources.readers import qualified
from loomwright.storage import shared_path


def write_rows(rows: DataFrame, root: str, table: str = "table") -> DataFrame:
    """Rows of several tables in one write, below a folder of this write and by table; returns ``table, rows_written``.

    Counts are of what was written: the written files are counted, by their footers, and the source is read once.
    """
    at = f"{root}/write_id={uuid.uuid4().hex}"
    rows.write.partitionBy(table).parquet(at)
    written = rows.sparkSession.read.schema(rows.schema).parquet(at)
    return written.groupBy(table).agg(F.count("*").alias("rows_written"))


def write_lines(lines: DataFrame, root: str, key: str = "key", value: str = "value") -> DataFrame:
    """Lines of several keys, below a folder of this write; returns ``key, lines_written, size`` (bytes with line ends) of what was written."""
    at = f"{root}/write_id={uuid.uuid4().hex}"
    lines.select(F.col(key).cast("string").alias(key), F.col(value).alias("value")).write.partitionBy(key).text(at)
    written = lines.sparkSession.read.schema(f"value string, `{key}` string").text(at)
    return written.groupBy(key).agg(F.count("*").alias("lines_written"), F.sum(F.octet_length("value") + 1).alias("size"))


def etag_of(spark: SparkSession, path: str) -> str | None:
    """The ETag (MD5 of the content) of a blob, or None if there is none."""
    fs, p = qualified(spark, path)
    if not fs.exists(p):
        return None
    return spark.read.format("binaryFile").load(path).select(F.md5("content")).first()[0]


def put_blob(spark: SparkSession, path: str, data: bytes, if_match: str = "", if_none_match: str = "", if_not_exist: bool = False) -> dict:
    """Write one blob where its preconditions hold, else FileExistsError or ValueError; returns key, size, mod_time and etag.

    ``if_not_exist`` is kept by the store itself; the ETags are compared right before the write.
    """
    fs, p = qualified(spark, path)
    if if_match and etag_of(spark, path) != if_match:
        raise ValueError(f"{path}: the ETag does not match")
    if if_none_match and etag_of(spark, path) == if_none_match:
        raise ValueError(f"{path}: the ETag matches")
    if if_not_exist and fs.exists(p):
        raise FileExistsError(path)
    out = fs.create(p, not if_not_exist)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    status = fs.getFileStatus(p)
    return {"key": path, "size": status.getLen(), "mod_time": status.getModificationTime(), "etag": etag_of(spark, path)}


def delete_blob(spark: SparkSession, path: str) -> bool:
    fs, p = qualified(spark, path)
    return fs.delete(p, False)


def copy_blob(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> None:
    """Copy one blob; an existing target is an error unless it is to be overwritten."""
    (fs, p), (fs2, q) = qualified(spark, source), qualified(spark, target)
    if fs2.exists(q) and not overwrite:
        raise FileExistsError(target)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, fs2, q, False, overwrite, spark._jsc.hadoopConfiguration())


def write_blob(df: DataFrame, path: str, if_not_exist: bool = False, form: str = "json") -> None:
    df.write.mode("errorifexists" if if_not_exist else "overwrite").format(form).save(path)


def define(spark: SparkSession, table: str, df: DataFrame, replace: bool = False) -> None:
    df.limit(0).write.mode("overwrite" if replace else "errorifexists").saveAsTable(table)


def drop(spark: SparkSession, table: str, force: bool = False) -> None:
    spark.sql(f"DROP TABLE {'IF EXISTS ' if force else ''}{table}")


def soft_delete(df: DataFrame, when: Column, now: Column) -> DataFrame:
    """Mark rows as deleted; earlier marks stay."""
    old = F.col("deleted_at") if "deleted_at" in df.columns else F.lit(None).cast("timestamp")
    return df.withColumn("deleted_at", F.coalesce(old, F.when(when, now)))


#: A feature's line may be as long as this.
MOST_BYTES = 10_000_000


def checked_features(lines: DataFrame, column: str = "value") -> DataFrame:
    """Feature texts; a line that is too long, is no Feature, or has no geometry, is an error that quotes its start."""
    v, start = F.try_parse_json(column), F.substring(column, 1, 80)
    kind, geometry = F.try_variant_get(v, "$.type", "string"), F.try_variant_get(v, "$.geometry.type", "string")
    refuse = lambda why: F.raise_error(F.concat(F.lit(why), start)).cast("int")
    ok = F.when(F.octet_length(column) > MOST_BYTES, refuse("line too long: ")).when(F.coalesce(kind, F.lit("")) != "Feature", refuse("no Feature: ")).when(geometry.isNull(), refuse("Feature without geometry: ")).otherwise(F.lit(1))
    return lines.where(ok == 1)


def write_feature_collection(lines: DataFrame, path: str, column: str = "value") -> None:
    """Part files that are one FeatureCollection each, so no task gathers all features; a feature is written on its own line."""
    if lines.isEmpty():
        raise ValueError("no features")

    def run(batches):
        import pyarrow as pa

        line = lambda texts: pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])
        begun = False
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if texts:
                yield line([t if k == 0 and not begun else "," + t for k, t in enumerate(texts)] if begun else ['{"type":"FeatureCollection","features":[', texts[0], *["," + t for t in texts[1:]]])
                begun = True
        if begun:
            yield line(["]}"])

    checked_features(lines, column).select(F.col(column).alias("value")).mapInArrow(run, "value string").write.mode("overwrite").text(path)


def encrypt(value: Column, key: Column) -> Column:
    return F.base64(F.aes_encrypt(value, key, F.lit("GCM")))


def decrypt(value: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(value), key, F.lit("GCM")).cast("string")


def enum_name(number: Column, names: dict[int, str], trim: str = "") -> Column:
    """An enum's name by its number, without a prefix; unknown numbers are null."""
    pairs = [x for k, v in names.items() for x in (F.lit(k), F.lit(v.removeprefix(trim).lstrip("_") if trim else v))]
    return F.try_element_at(F.create_map(*pairs), number)


def to_text(value: Column) -> Column:
    """A list, map or message as the JSON text that a text column stores."""
    return F.to_json(value)


def from_text(value: Column, kind: str) -> Column:
    """The list, map or message (of the given type) of a JSON text; a bad text is an error."""
    return F.from_json(value, kind, {"mode": "FAILFAST"})


def scratch(spark: SparkSession, label: str) -> str:
    return shared_path(spark, label)
