"""Stored tables in segments: an update writes the next version of the segments it touches and names it by replacing one small file.

<path>/<table>/version=V/segment=S/ holds a segment; manifest.json names each segment's version. Readers take the manifest once and read the
folders that it names, so they see the tables before an update or after it. Folders that no manifest names are left until vacuum().
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def place(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    p, fs = place(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the file and rename over it, in one step where the file system has one."""
    p, fs = place(spark, path)
    q, _ = place(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(q, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    kinds = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kinds, 1)
    options[0] = kinds.OVERWRITE
    uri = q.toUri() if q.toUri().getScheme() else fs.getUri()
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, spark._jsc.hadoopConfiguration()).rename(q, p, options)


@dataclass
class Versioned:
    """Tables in a folder that driver and executors share; TABLES names them with their columns (version and segment apart)."""

    spark: SparkSession
    path: str
    manifest: dict = field(default_factory=dict)
    TABLES = ()

    @classmethod
    def exists(cls, spark: SparkSession, path: str) -> bool:
        p, fs = place(spark, f"{path}/manifest.json")
        return fs.exists(p)

    @classmethod
    def open(cls, spark: SparkSession, path: str):
        text = read_text(spark, f"{path}/manifest.json")
        if text is None:
            raise FileNotFoundError(f"no index at {path}")
        return cls(spark, path, json.loads(text))

    @classmethod
    def new(cls, spark: SparkSession, path: str, segments: int, **more):
        return cls(spark, path, {"segments": segments, "version": 0, "current": {}} | more)

    def segment(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(self.manifest["segments"])).cast("int")

    def publish(self, tables: dict[str, DataFrame], touched: list[int] | None = None, by: tuple[str, ...] = (), more: dict | None = None) -> None:
        """Write the next version of the touched segments (all by default) and name it, together with `more` fields of the manifest.

        The tables have a column segment; `by` are further folders of the first. What a writer left that ended before it named its version is written over; there is one writer at a time.
        """
        version = self.manifest["version"] + 1
        for name, df in tables.items():
            df.write.mode("overwrite").partitionBy("segment", *(c for c in by if c in df.columns)).parquet(f"{self.path}/{name}/version={version}")
        there = range(self.manifest["segments"]) if touched is None else touched
        self.manifest = self.manifest | (more or {}) | {"version": version, "current": self.manifest["current"] | {str(s): version for s in there}}
        replace_text(self.spark, f"{self.path}/manifest.json", json.dumps(self.manifest))

    def table(self, name: str, schema: str, segments: list[int] | None = None) -> DataFrame:
        """The current files of a table; segments without rows have no folder."""
        wanted = [(s, v) for s, v in self.manifest["current"].items() if segments is None or int(s) in segments]
        paths = [f"{self.path}/{name}/version={v}/segment={s}" for s, v in wanted]
        paths = [p for p in paths if (lambda q, fs: fs.exists(q))(*place(self.spark, p))]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*paths)

    def vacuum(self) -> int:
        """Delete the folders that the manifest doesn't name; the number of them. Not while an older reader is at work."""
        gone = 0
        for name in self.TABLES:
            top, fs = place(self.spark, f"{self.path}/{name}")
            for version in fs.listStatus(top):
                v = version.getPath().getName().partition("=")[2]
                for segment in fs.listStatus(version.getPath()):
                    kind, _, s = segment.getPath().getName().partition("=")
                    if kind == "segment" and self.manifest["current"].get(s) != int(v):
                        gone += fs.delete(segment.getPath(), True)
        return gone
