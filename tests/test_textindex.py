"""The stored inverted index against scoring everything, and what an update touches."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from quillstream.operators import retrieval, textindex
from quillstream.operators.textindex import TextIndex

DOCS = "doc_id long, text string, lang string"


def corpus(n: int, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    rows = [(i * 3, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(200)], k=rng.randrange(1, 60))), rng.choice(("en", "fr"))) for i in range(n)]
    return rows + [(100_001, None, "en"), (100_002, "", None), (100_003, "Été ÉTÉ été w3", "fr")] + [(200_000 + i, "w7 w9 w150", "en") for i in range(40)]


QUESTIONS = [(1, "w0 w1 w2 w150", "en"), (2, "w199", "fr"), (3, "été?", "fr"), (4, "w7 w9 w150 w7", "en"), (5, "unknown words", "en"), (6, None, "en"), (7, "w0", None)]


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    docs = spark.createDataFrame(corpus(600), DOCS)
    return docs, TextIndex.create(spark, str(tmp_path_factory.mktemp("index")), docs, ("lang",), segment_docs=100)


def test_search_equals_scoring_everything(spark, made, monkeypatch):
    docs, index = made
    asked = spark.createDataFrame(QUESTIONS, "qid long, text string, lang string")
    assert index.manifest["segments"] == 7
    for k in (1, 5, 50):
        assert rows(index.bm25(asked, k)) == rows(retrieval.bm25(docs, asked, k))
    assert rows(index.bm25(asked, 5, equal="lang")) == rows(retrieval.bm25(docs, asked, 5, filters="lang"))
    assert rows(index.bm25(asked, 5, k1=0.7, b=0.2)) == rows(retrieval.bm25(docs, asked, 5, k1=0.7, b=0.2))
    monkeypatch.setattr(textindex, "QUESTIONS", 2)
    assert rows(index.bm25(asked, 5)) == rows(retrieval.bm25(docs, asked, 5))
    with pytest.raises(ValueError):
        index.bm25(asked, 5, equal="text")


def test_bounds_hold_and_leave_common_terms_out(spark, made):
    """Whatever the terms, the best of a segment are those of all scores; and the common terms aren't traversed where a rare one decides."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)
    blocks = []
    for t in range(12):
        docs = np.sort(rng.choice(3000, 2500 if t < 8 else 40, replace=False))
        for b, a in enumerate(range(0, len(docs), 128)):
            d = docs[a : a + 128]
            tf, dl = rng.integers(1, 9, len(d)), d % 90 + 10
            blocks.append((f"t{t}", b, int(tf.max()), int(dl.min()), d.tolist(), tf.tolist(), dl.tolist()))
    table = pa.table(dict(zip(("term", "block", "max_tf", "min_dl", "docs", "tfs", "dls"), map(list, zip(*blocks)))))
    segment = textindex._Segment(table, 1.2, 0.75, 50.0)
    for _ in range(60):
        asked = [(f"t{t}", float(rng.choice((0.01, 0.4, 3.0, 6.0)))) for t in rng.choice(13, int(rng.integers(1, 9)), replace=False)]
        whole = np.zeros(len(segment.ids))
        for t, idf in asked:
            if t in segment.terms:
                _, _, a, z = segment.terms[t]
                whole[segment.places[a:z]] += idf * segment.adds[a:z]
        ids, scores = segment.best(asked, 7, None)
        want = np.sort(whole[whole > 0])[::-1][:7]
        assert np.allclose(np.sort(scores)[::-1], want) and np.allclose(whole[np.searchsorted(segment.ids, ids)], scores)


def test_update_touches_only_its_segments(spark, tmp_path):
    old = corpus(300, 2)
    index = TextIndex.create_or_update(spark, str(tmp_path), spark.createDataFrame(old, DOCS), ("lang",))
    index = TextIndex.create(spark, str(tmp_path / "small"), spark.createDataFrame(old, DOCS), ("lang",), segment_docs=50)
    files = lambda: {os.path.join(p, f): os.stat(os.path.join(p, f)).st_mtime_ns for p, _, names in os.walk(tmp_path / "small" / "postings") for f in names}
    before = files()
    reader = TextIndex.open(spark, str(tmp_path / "small"))
    changed = [(3, "w0 w0 fresh", "fr"), (999_999, "quite fresh words", "en")]
    touched = index.update(spark.createDataFrame(changed, DOCS), deleted=spark.createDataFrame([(6,), (200_001,), (77,)], "doc_id long"))
    after = files()
    assert 0 < len(touched) < index.manifest["segments"] and all(after[f] == t for f, t in before.items())
    assert {f.split("segment=")[1].split("/")[0] for f in after.keys() - before.keys() if "segment=" in f} == {str(s) for s in touched}
    now = [r for r in old if r[0] not in (3, 6, 200_001)] + changed
    asked = spark.createDataFrame([*QUESTIONS, (8, "fresh w0", "fr")], "qid long, text string, lang string")
    assert rows(index.bm25(asked, 10)) == rows(retrieval.bm25(spark.createDataFrame(now, DOCS), asked, 10))
    assert rows(reader.bm25(asked, 10)) == rows(retrieval.bm25(spark.createDataFrame(old, DOCS), asked, 10))  # its manifest is the older one
    assert index.vacuum() == 2 * len(touched) and rows(TextIndex.open(spark, str(tmp_path / "small")).bm25(asked, 10)) == rows(index.bm25(asked, 10))
    with pytest.raises(ValueError):
        TextIndex.create_or_update(spark, str(tmp_path / "small"), spark.createDataFrame(old, DOCS))


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], DOCS)
    index = TextIndex.create(spark, str(tmp_path), none)
    asked = spark.createDataFrame(QUESTIONS, "qid long, text string, lang string")
    assert index.bm25(asked, 3).count() == 0
    assert index.update(spark.createDataFrame([(1, "w0 w1", "en")], DOCS)) == [0]
    assert rows(index.bm25(asked, 3)) == rows(retrieval.bm25(spark.createDataFrame([(1, "w0 w1", "en")], DOCS), asked, 3))
    assert index.bm25(asked.where("false"), 3).count() == 0
    with pytest.raises(FileNotFoundError):
        TextIndex.open(spark, str(tmp_path / "none"))


def test_the_plan_reads_the_terms_buckets_and_no_text(spark, made, capsys):
    _, index = made
    found = index.bm25(spark.createDataFrame([(1, "w199 w198")], "qid long, text string"), 3)
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "bucket" in plan.split("PartitionFilters")[1][:200] and "postings" in plan and "text#" not in plan


def test_segments_stay_small_as_the_table_grows(spark, tmp_path):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 50, F.lit(" v"), F.col("id") % 7).alias("text"))
    index = TextIndex.create(spark, str(tmp_path / "many"), docs)
    assert index.manifest["segments"] == 3  # a task of a search holds the postings of one
    asked = spark.createDataFrame([(1, "w3 v5"), (2, "v1")], "qid long, text string")
    assert sorted(index.bm25(asked, 5).collect()) == sorted(retrieval.bm25(docs, asked, 5).collect())


def test_no_row_for_each_word_is_dealt_or_sorted(spark, tmp_path, monkeypatch):
    """creating and updating cut whole arrays into blocks; rows by word took most of the seconds."""
    seen, publish = [], TextIndex.publish
    monkeypatch.setattr(TextIndex, "publish", lambda self, tables, *a, **k: (seen.append(tables["postings"]._jdf.queryExecution().optimizedPlan().toString()), publish(self, tables, *a, **k))[1])
    docs = [(1, "B b a", "en"), (2, None, "en"), (3, " -- ", None), (4, "", "fr"), (5, "Straße İSTANBUL a_b 12,5 a", "fr"), (None, "lost", "en")]
    index = TextIndex.create(spark, str(tmp_path), spark.createDataFrame(docs, DOCS), ("lang",))
    lists = {r["term"]: (r["docs"], r["tfs"], r["dls"], r["n"], r["lo"], r["hi"], r["max_tf"], r["min_dl"]) for r in index.blocks().collect()}
    assert lists["a"] == ([1, 5], [1, 2], [3, 8], 2, 1, 5, 2, 3) and lists["b"] == ([1, 5], [2, 1], [3, 8], 2, 1, 5, 2, 3)
    assert sorted(lists) == sorted({"a", "b", "straße", "i", "stanbul", "12", "5"})  # the dot over a lower-cased İ is a mark, no letter
    assert sorted((r["doc_id"], r["dl"], r["lang"]) for r in index.documents().collect()) == [(1, 3, "en"), (2, 0, "en"), (3, 0, None), (4, 0, "fr"), (5, 8, "fr")]
    index.update(spark.createDataFrame([(1, "a c", "en")], DOCS), deleted=spark.createDataFrame([(5,)], "doc_id long"))
    assert sorted((r["term"], r["docs"], r["dls"]) for r in index.blocks().collect()) == [("a", [1], [2]), ("c", [1], [2])]
    assert len(seen) == 2 and not any(part in plan for plan in seen for part in ("Generate", "collect_list"))


def test_blocks_end_at_their_size(spark, tmp_path):
    rows = [(i, "x y" if i % 2 else "x x") for i in range(1, 301)]
    index = TextIndex.create(spark, str(tmp_path), spark.createDataFrame(rows, "doc_id long, text string"))
    found = sorted((r["term"], r["block"], r["n"], r["lo"], r["hi"], r["max_tf"]) for r in index.blocks().collect())
    assert found == [("x", 0, 128, 1, 128, 2), ("x", 1, 128, 129, 256, 2), ("x", 2, 44, 257, 300, 2), ("y", 0, 128, 1, 255, 1), ("y", 1, 22, 257, 299, 1)]


def test_small_segments_have_one_file_and_share_a_task(spark, tmp_path):
    """segments of 512 documents had 16 files each, and each met all questions in a task of its own."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 50, F.lit(" v"), F.col("id") % 7).alias("text"))
    index = TextIndex.create(spark, str(tmp_path), docs, segment_docs=1 << 9)
    files = [f for p, _, names in os.walk(tmp_path / "postings") for f in names if f.endswith(".parquet")]
    assert index.manifest["segments"] == len(files) == 6
    asked = spark.createDataFrame([(1, "w3 v5"), (2, "v1")], "qid long, text string")
    assert rows(index.bm25(asked, 5)) == rows(retrieval.bm25(docs, asked, 5))
