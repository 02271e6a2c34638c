"""Shared helpers: checked broadcasts, slices of batches, scratch tables."""

import os

import pyarrow as pa
from pyspark.sql import functions as F

from quillstream.llm import common


def hinted(df) -> bool:
    return "broadcast" in df._jdf.queryExecution().logical().toString().lower()


def test_small_counts_rows_and_bytes(spark):
    rows = spark.range(100).select("id", F.lit("x").alias("a.b"), F.array(F.lit(1), F.lit(2)).alias("n"))
    assert hinted(common.small(rows)) and not hinted(common.small(rows, rows=99)) and not hinted(common.small(rows, most=100))
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("s"), F.array(F.struct(F.repeat(F.lit("y"), 500).alias("t"))).alias("l"), F.create_map(F.lit("k"), F.repeat(F.lit("z"), 500)).alias("m"), F.lit(None).cast("binary").alias("b"))
    assert not hinted(common.small(wide, most=19_000)) and hinted(common.small(wide, most=30_000))
    assert hinted(common.small(wide.where("false")))


def test_pieces_of_batches():
    batch = pa.RecordBatch.from_arrays([pa.array(range(10))], names=["x"])
    assert [p.column("x").to_pylist() for p in common.text_pieces([batch, batch.slice(0, 0)], 4)] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]


def test_operators_leave_the_session_as_it_is(spark, sf):
    from quillstream.llm import queries

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name in ("op4_toxicity", "op8_line_dedup", "op9_langid"):
        queries.QUERIES[name](spark, sf).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_scratch_tables_can_be_forgotten(spark):
    common.written(spark.range(3))
    place = common.scratch_dir(spark).removeprefix("file://").removeprefix("file:")
    assert os.listdir(place)
    common.forget(spark)
    assert not os.path.exists(place)
    assert common.written(spark.range(3)).count() == 3
