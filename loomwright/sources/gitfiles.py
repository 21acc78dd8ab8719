"""A read-only file system at a ref of a git repository, as a data source: ``spark.read.format("git")``.

Options: ``url`` (a path, file:// or ssh:// URL that every executor reaches), ``ref`` (HEAD), ``paths`` (comma-separated
pathspecs, each read by a task of its own; all files by default). The files come over ``git archive``, never by a local clone.
"""

from __future__ import annotations

import io
import subprocess
import tarfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, size long, content binary"


class GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.ref = options["url"].removeprefix("git+"), options.get("ref", "HEAD")
        self.paths = [p for p in options.get("paths", "").split(",") if p] or [""]
        if self.url.startswith("-") or self.ref.startswith("-") or any(p.startswith("-") for p in self.paths):
            raise ValueError("an option of git can't stand for a url, ref or path")

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        done = subprocess.run(["git", "archive", "--format=tar", f"--remote={self.url}", self.ref, *[p for p in [partition.value] if p]], capture_output=True)
        if done.returncode:
            raise OSError(done.stderr.decode(errors="replace").strip())
        with tarfile.open(fileobj=io.BytesIO(done.stdout)) as tar:
            for m in tar:
                if m.isfile():
                    yield m.name, m.size, tar.extractfile(m).read()


class GitSource(DataSource):
    @classmethod
    def name(cls):
        return "git"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return GitReader(dict(self.options))

    def writer(self, schema, overwrite):
        raise PermissionError("git is read-only")


def read_git(spark: SparkSession, url: str, ref: str = "HEAD", paths: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(GitSource)
    return spark.read.format("git").options(url=url, ref=ref, paths=",".join(paths or [])).load()
