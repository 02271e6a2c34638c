"""Streams over files: the daily counter with late events, and exactly-once upserts over a failure and a restart."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillstream.operators import incremental, versioned
from quillstream.streaming import counters, upserts

EVENTS = "event_id long, ts timestamp_ntz"


def arrive(spark, folder, rows, schema=EVENTS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def run(spark, stream, folder):
    writer = counters.running_daily_stream(stream, "1 hour").writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp")
    writer.trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.read.schema("day date, event_id long, requests_today long").parquet(f"{folder}/out").collect()))


def test_late_events_are_counted_in_their_place_and_the_count_starts_anew(spark, tmp_path):
    at = lambda d, h, m=0: dt.datetime(2024, 1, d, h, m)
    folder = str(tmp_path)
    arrive(spark, f"{folder}/in", [(1, at(1, 10)), (2, at(1, 12)), (9, at(1, 12)), (99, None)])
    arrive(spark, f"{folder}/in", [(3, at(1, 11, 30)), (4, at(1, 23, 59)), (5, at(2, 0))])  # 3 is half an hour late
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    first = run(spark, stream, folder)
    one = dt.date(2024, 1, 1)
    assert first == [(one, 1, 1), (one, 2, 3), (one, 3, 2), (one, 9, 4)]  # up to 23:00, when the watermark stands
    arrive(spark, f"{folder}/in", [(6, at(1, 9)), (7, at(2, 0, 30)), (8, at(1, 23, 30))])  # 6 is too late, 8 isn't
    arrive(spark, f"{folder}/in", [(10, at(9, 0))])
    rest = run(spark, stream, folder)  # a restart from the checkpoint
    two = dt.date(2024, 1, 2)
    assert rest == sorted([*first, (one, 8, 5), (one, 4, 6), (two, 5, 1), (two, 7, 2)])


def test_upserts_survive_a_failure_and_a_restart(spark, tmp_path, monkeypatch):
    base = spark.createDataFrame([(i, "old", None) for i in range(100)] + [(None, "x", None)], "k long, v string, m map<string,int>")
    table = upserts.KeyedTable.create(spark, str(tmp_path / "t"), base, "k", segment_rows=20)
    schema = "k long, v string, m map<string,int>, version long"
    batches = [[(1, "b", {"a": 1}, 2), (2, "b", None, 2), (1, "a", None, 1)], [(1, "late", None, 1), (3, "c", None, 1), (500, "new", None, 1)], [(2, "d", None, 3), (None, "x", None, 9)]]
    for rows in batches:
        arrive(spark, str(tmp_path / "in"), rows, schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def start():
        stream.writeStream.foreachBatch(upserts.KeyedTable.sink(table.path, "s")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    real, calls = versioned.replace_text, []

    def dies(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("the driver is gone")  # the second batch's files are written, its manifest isn't
        return real(*args)

    monkeypatch.setattr(versioned, "replace_text", dies)
    with pytest.raises(Exception):
        start()
    half = upserts.KeyedTable.open(spark, table.path)
    assert half.manifest["ledger"] == {"s": 0} and half.rows().where("k = 500").isEmpty()
    start()
    done = upserts.KeyedTable.open(spark, table.path)
    assert done.manifest["ledger"] == {"s": 2}
    updates = spark.createDataFrame([r for b in batches for r in b if r[0] is not None], schema)
    want = incremental.upsert(base.where("k is not null"), updates, "k")
    rows = lambda df: sorted(str(r) for r in df.select("k", "v", F.map_entries("m")).collect())
    assert rows(done.rows()) == rows(want)
    assert done.merge(spark.createDataFrame(batches[0], schema), "s", 0) == [] and done.merge(spark.createDataFrame([(1, "again", None, 9)], schema), "s", 2) == []
    assert rows(upserts.KeyedTable.open(spark, table.path).rows()) == rows(want)
    before = done.manifest["current"]
    touched = done.merge(spark.createDataFrame([(7, "z", None, 5)], schema), "other", 0)
    assert len(touched) == 1 and sum(before[s] != v for s, v in done.manifest["current"].items()) == 1
