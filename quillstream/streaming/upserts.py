"""A keyed table that batches of a stream are merged into, each exactly once.

The table lies in segments by the hash of its key. A batch rewrites the segments of its keys and is entered in a ledger, by the name of the stream, in the same
manifest that names the new segments: either both are there or neither. A batch that comes again after a restart is found in the ledger and left out; one whose writer ended
half way is merged anew, over what it left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.operators.versioned import Versioned
from quillstream.scratch import written

#: Rows of a segment (expected).
SEGMENT_ROWS = 1 << 20


class KeyedTable(Versioned):
    """Rows by a long key, the one with the largest version each; null keys are left out."""

    TABLES = ("rows",)

    @classmethod
    def create(cls, spark: SparkSession, path: str, rows: DataFrame, key: str, segment_rows: int = SEGMENT_ROWS) -> "KeyedTable":
        """rows may have a column version; without one theirs is 0, below every update's. Rows of one key: as in merge."""
        rows = rows if "version" in rows.columns else rows.withColumn("version", F.lit(0))
        rows = rows.withColumn("version", F.col("version").cast("long"))
        made = cls.new(spark, path, max(1, -(-rows.count() // segment_rows)), key=key, columns=rows.columns, schema=rows.schema.simpleString()[7:-1], ledger={})
        made.publish({"rows": made._newest(rows)})
        return made

    def _newest(self, rows: DataFrame) -> DataFrame:
        """One row for each key: the largest version, of equal ones the largest hash of its columns."""
        key, names = self.manifest["key"], self.manifest["columns"]
        order = Window.partitionBy(key).orderBy(F.desc("version"), F.desc(F.xxhash64(F.to_json(F.struct(*names)))))
        best = rows.where(F.col(key).isNotNull()).select(*names).withColumn("the nth", F.row_number().over(order)).where("`the nth` = 1")
        # the row is one column, so that its names are apart from those of the folders
        return best.select(F.struct(*names).alias("row"), self.segment(key).alias("segment")).repartition("segment")

    def rows(self, segments: list[int] | None = None) -> DataFrame:
        return self.table("rows", f"row struct<{self.manifest['schema']}>, segment int", segments).select("row.*")

    def merge(self, updates: DataFrame, stream: str | None = None, batch: int | None = None) -> list[int]:
        """Merge updates (the table's columns, with version); the segments that were rewritten, none if the ledger has the batch."""
        ledger = dict(self.manifest["ledger"])
        if stream is not None and batch is not None:
            if batch <= ledger.get(stream, -1):
                return []
            ledger[stream] = batch
        key = self.manifest["key"]
        fresh = written(updates.where(F.col(key).isNotNull()).select(*[F.col(c).cast(self._types()[c]).alias(c) for c in self.manifest["columns"]]))
        touched = sorted(r["segment"] for r in fresh.select(self.segment(key).alias("segment")).distinct().collect())  # at most one row a segment
        if touched:
            self.publish({"rows": self._newest(self.rows(touched).unionByName(fresh))}, touched, more={"ledger": ledger})
        elif stream is not None:
            self.publish({}, [], more={"ledger": ledger})
        return touched

    def _types(self) -> dict[str, str]:
        return dict(part.split(":", 1) for part in _fields(self.manifest["schema"]))

    @classmethod
    def sink(cls, path: str, stream: str) -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch: merges each batch once, however often it comes."""

        def merge(batch: DataFrame, number: int) -> None:
            cls.open(batch.sparkSession, path).merge(batch, stream, number)

        return merge


def _fields(schema: str) -> list[str]:
    """name:type of the fields of a simple struct string, commas inside types apart."""
    out, depth, now = [], 0, ""
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return out + [now] if now else out
