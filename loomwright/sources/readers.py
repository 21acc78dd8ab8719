"""Row scans, blobs, delimited lines, JSON, archives and catalog listings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.types import field_of


def read_rows(df: DataFrame, order: list[str], offset: int = 0, limit: int | None = None, selected: list[str] | None = None) -> DataFrame:
    """A scan with an offset in a stated order and a column selection (none or empty: all)."""
    df = df.select(*selected, *[c for c in order if c not in selected]) if selected else df
    df = df.orderBy(*order).offset(offset)
    df = df if limit is None else df.limit(limit)
    return df.select(*selected) if selected else df


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row."""
    return df.select(F.to_json(F.struct("*")).alias("row"))


def qualified(spark: SparkSession, path: str):
    """(file system, qualified path) of a path, as Hadoop's objects."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def list_blobs(spark: SparkSession, path: str, prefix: str = "", size: int = 50, after: str = "") -> DataFrame:
    """Keys (paths below the root) by prefix, with length and time; pages of at most 1000 keys. Contents aren't read."""
    root = qualified(spark, path)[1].toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    key = F.when(F.col("path").startswith(root), F.substring("path", len(root) + 1, 1 << 30)).otherwise(F.element_at(F.split(F.col("path"), "/"), -1))
    return files.withColumn("key", key).where(F.col("key").startswith(prefix) & (F.col("key") > after)).orderBy("key").limit(max(1, min(1000, size or 50)))


def get_blob(spark: SparkSession, path: str) -> DataFrame:
    etag = F.md5("content")
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime", etag.alias("md5"), etag.alias("etag"), F.concat(F.lit("SHA256:"), F.sha2("content", 256)).alias("checksum"))


def blob_range(spark: SparkSession, path: str, offset: int, length: int) -> DataFrame:
    """``length`` bytes at most from an offset; a negative length reads all that follows.

    Of one file, only these bytes are read; of a folder, each file is read and cut.
    """
    fs, p = qualified(spark, path)
    if length >= 0 and fs.getFileStatus(p).isFile():
        n = max(0, min(length, fs.getFileStatus(p).getLen() - offset))
        file = fs.open(p)
        try:
            file.seek(min(offset, fs.getFileStatus(p).getLen()))
            data = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(file, n)) if n else b""
        finally:
            file.close()
        return spark.createDataFrame([(p.toString(), bytearray(data))], "path string, data binary")
    part = F.expr(f"substring(content, {offset + 1})") if length < 0 else F.expr(f"substring(content, {offset + 1}, {length})")
    return spark.read.format("binaryFile").load(path).select("path", part.alias("data"))


def blob_lines(spark: SparkSession, path: str, delimiter: str = "\n", max_size: int | None = None, form: str = "raw", schema=None, array: bool = False) -> DataFrame:
    """Delimited lines, raw or JSON; ``array`` reads files that are one JSON array. A raw line over max_size bytes is an error."""
    if form == "json":
        if array and delimiter != "\n":
            raise ValueError("an array has no delimiter")
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.option("multiLine", array).json(path) if array or delimiter == "\n" else reader.option("lineSep", delimiter).json(path)
    lines = spark.read.option("lineSep", delimiter).text(path)
    if max_size is None:
        return lines
    size = F.octet_length("value")
    return lines.select(F.when(size <= max_size, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("a line of "), size.cast("string"), F.lit(f" bytes, over {max_size}"))).cast("string")).alias("value"))


def json_values(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """``value``: the JSON texts of files that hold values one after the other, with or without white space, or one array of them.

    A file is read by one task, and cut value by value; text that is no JSON is an error.
    """

    def run(batches):
        import json

        import pyarrow as pa

        decoder, blank = json.JSONDecoder(), re.compile(r"[\s,]*" if array else r"\s*")
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py().decode()
                at, out = blank.match(text).end(), []
                if array:
                    if text[at : at + 1] != "[":
                        raise ValueError("a stream of an array starts with [")
                    at = blank.match(text, at + 1).end()
                while at < len(text) and not (array and text[at] == "]"):
                    end = decoder.raw_decode(text, at)[1]
                    out.append(text[at:end])
                    at = blank.match(text, end).end()
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                        out = []
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "value string")


def yaml_values(spark: SparkSession, path: str, delimiter: str = "---") -> DataFrame:
    """``value``: the documents of YAML files as JSON texts; lines that are the delimiter separate them, empty ones are left out."""

    def run(batches):
        import json

        import pyarrow as pa
        import yaml

        for batch in batches:
            for text in batch.column(0):
                parts = re.split(rf"(?m)^{re.escape(delimiter)}[ \t]*$", text.as_py().decode())
                out = [json.dumps(yaml.safe_load(p), default=str) for p in parts if p.strip()]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "value string")


def split_delimited(df: DataFrame, column: str, delimiter: str) -> DataFrame:
    """Tokens between delimiters; a final partial token is one, an empty end isn't."""
    parts = F.split(F.col(column), re.escape(delimiter))
    n = F.size(parts)
    return df.select("*", F.posexplode(F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), n - 1)).otherwise(parts)).alias("pos", "token"))


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """The members of zip archives, one row each; an archive is one task's work."""

    def run(batches):
        import io
        import zipfile

        import pandas as pd

        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    yield pd.DataFrame([(p, i.filename, i.file_size, z.read(i)) for i in z.infolist() if not i.is_dir()], columns=["path", "member", "size", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, member string, size long, content binary")


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_id, total_rows`` for each table: one aggregate over a union, counted from file footers where Spark can."""
    parts = [df.agg(F.count("*").alias("total_rows")).select(F.lit(name).alias("table_id"), "total_rows") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def table_bytes(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_id, total_rows, total_bytes`` of tables that are read from files, from the files' metadata."""
    parts = []
    for name, df in tables.items():
        files = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s")).groupBy("f").agg(F.count("*").alias("n"), F.first("s").alias("s"))
        parts.append(files.agg(F.sum("n").alias("total_rows"), F.sum("s").alias("total_bytes")).select(F.lit(name).alias("table_id"), "total_rows", "total_bytes"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def describe(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """The columns of all tables with kinds: dtype, ordinal, nullable, repeated."""
    rows = [(t, f["name"], i, f["type"], f["native"], f["nullable"], f["repeated"]) for t, df in tables.items() for i, f in enumerate(map(field_of, df.schema.fields))]
    return spark.createDataFrame(rows, "table_id string, column string, ordinal int, kind string, native string, nullable boolean, repeated boolean")


def browse(spark: SparkSession, pattern: str = "*") -> DataFrame:
    """Databases and their tables."""
    rows = [(d.catalog, d.name, t.name, t.tableType) for d in spark.catalog.listDatabases() for t in spark.catalog.listTables(d.name, pattern)]
    return spark.createDataFrame(rows, "catalog string, schema string, table_id string, kind string")
