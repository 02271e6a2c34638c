"""Single files that appear as a whole, golden sets with their faults, and the assembly of a document's record."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from quillstream.sources import files


def test_a_single_file_is_there_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "report.md")
    rows = spark.createDataFrame([(2, "second"), (1, "first"), (3, "é")], "n int, line string")
    files.write_single(rows, path, order="n")
    assert open(path, encoding="utf-8").read() == "first\nsecond\né\n"
    fails = rows.withColumn("line", F.when(F.col("n") == 3, F.raise_error(F.lit("a task is lost"))).otherwise(F.lit("new")))
    with pytest.raises(Exception):
        files.write_single(fails, path)
    assert open(path, encoding="utf-8").read().startswith("first")  # the file before
    files.write_single(rows.where("n = 1").select("line"), path)
    assert open(path, encoding="utf-8").read() == "first\n" and [f for f in os.listdir(tmp_path) if not f.startswith(".")] == ["report.md"]
    files.write_single(rows.where("false").select("line"), path)
    assert open(path).read() == ""


def test_golden_sets_of_both_layouts(spark, tmp_path):
    q = lambda i, **more: {"id": i, "act": "x", "query": "q", "gold": [{"section_number": "1", "relevance_grade": 1, "chunk_ids": ["c"]}]} | more
    sets = {"a.json": {"acts": {"x": {"questions": [q("1"), q("2")]}, "y": {"questions": [q("3", query=None)]}}}, "b.json": {"questions": [q("2"), {"act": "x", "query": "q"}]}, "c.json": {"other": []}, "d.json": {"questions": []}}
    for name, value in sets.items():
        (tmp_path / name).write_text(json.dumps(value))
    (tmp_path / "e.txt").write_text("no golden set")
    found = files.golden_set(spark, str(tmp_path), "*.json")
    assert found.where("pos is not null").count() == 5
    faults = sorted((os.path.basename(r.file), r.pos, r.id, r.fault) for r in files.golden_faults(found).collect())
    want = [("a.json", 1, "2", "duplicate_id"), ("a.json", 2, "3", "missing_query"), ("b.json", 0, "2", "duplicate_id"), ("b.json", 1, None, "missing_gold"), ("b.json", 1, None, "missing_id"), ("c.json", None, None, "no_questions")]
    assert [f for f in faults if f[0] != "d.json"] == want and [f[3] for f in faults if f[0] == "d.json"] == ["no_questions"]
