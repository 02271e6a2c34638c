"""Resumable loads: pending and orphaned rows, batches, upserts, symmetric differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.scratch import small, written


def pending(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return source.join(done.select(key).distinct(), key, "left_anti")


def orphans(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return done.join(source.select(key).distinct(), key, "left_anti")


def last_of(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The last row of each key."""
    names = [c for c in rows.columns if c != key]
    top = rows.groupBy(key).agg(F.max_by(F.struct(*names), version).alias("x"))
    return top.select(key, "x.*")


def batches(rows: DataFrame, key: str, size: int) -> DataFrame:
    """batch_id: rows by key in groups of `size`. Row numbers come from two levels of counts, not from one sorted partition."""
    spread = written(rows.repartitionByRange(key).withColumn("part", F.spark_partition_id()))  # stored: both uses see the same ranges
    counts = spread.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each partition
    inside = F.row_number().over(Window.partitionBy("part").orderBy(key))
    placed = spread.withColumn("nth", inside).join(small(counts.select("part", before.alias("before"))), "part")
    return placed.withColumn("batch_id", F.expr(f"cast((before + nth - 1) div {size} as bigint)")).drop("part", "nth", "before")


def upsert(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Rows of updates replace rows of the table with their key; the last update of a key wins by `version`."""
    newest = updates.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("version")))).where("nth = 1").drop("nth", "version")
    return table.join(newest.select(key), key, "left_anti").unionByName(newest.select(*table.columns))


def settled(source: DataFrame, done: DataFrame, key: str, tries: int = 20, wait: float = 3.0, again=None) -> bool:
    """Poll until both sides hold the same keys, `tries` times with `wait` seconds between; again() reads the done side anew."""
    import time

    for n in range(tries):
        if done.select(key).exceptAll(source.select(key)).isEmpty() and source.select(key).exceptAll(done.select(key)).isEmpty():
            return True
        if n + 1 < tries:
            time.sleep(wait)
            done = again() if again else done
    return False
