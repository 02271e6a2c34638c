import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstream.llm import line_dedup, minhash, queries
from tests.llm.helpers import corpus, edited, frame, prose


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_all_pairs(spark, k):
    rows = corpus()
    got = minhash.near_duplicates(frame(spark, rows), k).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(minhash.brute_force(rows, k))


def test_near_duplicates_of_nothing(spark):
    empty = frame(spark, corpus()).where("false")
    assert minhash.near_duplicates(empty, 2).count() == 0
    odd = minhash.near_duplicates(frame(spark, [(None, "a b c"), (None, "a b c"), (1, None)]), 2).collect()
    assert sorted(((r.doc_id, r.component_id) for r in odd), key=str) == [(1, 1), (None, None), (None, None)]


def test_links_of_rows_without_id(spark):
    text = prose(60, 1)
    rows = [(None, text), (1, text + " tail"), (2, prose(60, 2)), (None, prose(60, 3)), (None, prose(60, 3) + " x")]
    got = minhash.near_duplicates(frame(spark, rows), 2).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == [(1, 1), (2, 2), (None, 1), (None, None), (None, None)]
    kept = minhash.keep_one(frame(spark, rows), 2).collect()
    assert sorted((str(r.doc_id) for r in kept)) == ["1", "2", "None"]


@pytest.mark.parametrize(("cell", "most"), [(4, 1 << 24), (1024, 30), (8, 0)])
def test_large_buckets_of_texts_on_templates(spark, monkeypatch, cell, most):
    """Texts that share 60 to 85 % of a template: many in a bucket, few of them linked; dealt in cells, or split by longer keys."""
    monkeypatch.setattr(minhash, "CELL", cell)
    monkeypatch.setattr(minhash, "PAIRS", most)
    base = prose(200, 77)
    rows = [(i, edited(base, 4 + i % 23, i)) for i in range(90)] + [(500 + i, edited(prose(200, 78), 30, i)) for i in range(30)]
    got = minhash.near_duplicates(frame(spark, rows), 2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(minhash.brute_force(rows, 2))


def test_many_copies(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HOT_COPIES", 5)
    rows = corpus()
    got = minhash.near_duplicates(frame(spark, rows), 2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(minhash.brute_force(rows, 2))


def test_longer_keys_miss_no_more():
    for rows in range(minhash.LONGER, minhash.LONGEST + 1, minhash.STEP):
        n = minhash.longer_bands(rows, 80)
        assert (1 - 0.8**rows) ** n <= minhash.MISS < (1 - 0.8**rows) ** (n - 1)


def test_keep_one_of_repeated_rows_with_clashing_names(spark):
    rows = [(1, prose(30, 1), i) for i in range(5)] + [(1, prose(30, 2), 9), (2, prose(30, 1), 0), (3, None, 1), (3, None, 2), (None, "", 3)]
    names = ("kept", "row", "rid", "node", "kept_id", "a.b")
    docs = spark.createDataFrame([(*r, *[1] * len(names)) for r in rows], f"doc_id long, text string, v int, {', '.join(f'`{n}` int' for n in names)}")
    first = minhash.keep_one(docs, 2)
    assert first.columns == docs.columns
    got = sorted((str(r.doc_id), str(r.text), r.v) for r in first.collect())
    assert [g[:2] for g in got] == [("1", prose(30, 1)), ("1", prose(30, 2)), ("3", "None"), ("None", "")] or [g[:2] for g in got] == [("1", prose(30, 2)), ("1", prose(30, 1)), ("3", "None"), ("None", "")]
    assert got == sorted((str(r.doc_id), str(r.text), r.v) for r in minhash.keep_one(docs.repartition(7), 2).collect())


def test_keep_one(spark):
    rows = corpus()
    kept = minhash.keep_one(frame(spark, rows), 5)
    want = {d for d, _, c in minhash.brute_force(rows, 5) if d == c}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert kept.columns == frame(spark, rows).columns


def test_query_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = minhash.brute_force([tuple(r) for r in docs.collect()], 2)
    got = queries.QUERIES["op2_minhash"](spark, sf).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_estimate_is_near_the_truth(spark):
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
    a, b = (np.concatenate([common, rng.integers(0, 1 << 63, 100, dtype=np.uint64)]) for _ in "ab")
    minima = minhash._minima(np.concatenate([a, b]), np.array([0, len(a)]), minhash.WIDE)
    x, y = minhash.pack_bits(minima).tolist()
    df = spark.createDataFrame([(x, y)], "a array<long>, b array<long>")
    differ = df.select(minhash.unequal_minima("a", "b", minhash.WIDE).alias("n")).first().n
    assert abs(1 - differ / minhash.WIDE / 0.75 - 0.8) < 0.06


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in minhash.components(edges).collect()}
    assert {v for k, v in got.items() if k <= 40} == {0} and got[101] == 100


LONG = "this line is long enough to count"


def test_lines_equal_brute_force(spark):
    rows = [(1, f"{LONG}\nown words of one document here\n{LONG}"), (2, f"  {LONG.upper()} \nshort"), (3, f"{LONG}\t\n{LONG}\nx"), (3, f"{LONG}"), (4, None), (5, ""), (None, LONG), (6, "\n\n"), (7, "ä" * 19), (8, "ä" * 20), (9, "ä" * 20), (10, "ä" * 20), (10, "ä" * 20)]
    rows += [(1000 + i, "\n".join([LONG if i % 2 else "z", "y" * 25, f"only {i} " * 5])) for i in range(50)]
    got = line_dedup.line_dedup_report(frame(spark, rows))
    key = lambda r: str(r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(line_dedup.brute_force(rows), key=key)


def test_runs_that_cross_partitions(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PARTITION_ROWS", 7)
    rows = [(i, "\n".join(["a" * 20, f"{i % 3}" * 20, "b" * 20 if i < 3 else "c"])) for i in range(60)]
    got = line_dedup.line_dedup_report(frame(spark, rows))
    assert sorted(map(tuple, got.collect())) == sorted(line_dedup.brute_force(rows))


def test_lines_of_nothing(spark):
    assert line_dedup.line_dedup_report(frame(spark, [(1, "a")]).where("false")).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 300), st.sets(st.integers(0, 299)))
def test_bitmaps_round_trip(n, gone):
    gone = np.array(sorted(g for g in gone if g < n), np.int64)
    keep = line_dedup.unpack_keep(line_dedup.pack_keep(gone, n), n)
    assert len(keep) == n and np.flatnonzero(~keep).tolist() == gone.tolist()


def test_line_query_equals_sql(oracle):
    oracle.check(queries.QUERIES["op8_line_dedup"], queries.ORACLES["op8_line_dedup"])


def test_replace_texts_keeps_columns(spark):
    docs = frame(spark, [(i, f"{LONG}\n{i}") for i in range(4)])
    out = line_dedup.replace_texts(docs)
    assert out.columns == docs.columns and out.where(F.length("text") != F.col("n_chars")).isEmpty()
    assert sorted(r.text for r in out.collect()) == ["0", "1", "2", f"{LONG}\n3"]


def test_repeated_rows_emit_their_lines_once(spark):
    rows = [(1, f"{LONG}\nx\n{LONG}")] * 300 + [(2, LONG), (3, LONG), (3, f"{LONG} \nother")]
    got = line_dedup.line_dedup_report(frame(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == sorted(line_dedup.brute_force(rows))
    maps = line_dedup.keep_bitmaps(frame(spark, rows)).collect()
    assert len(maps) == 2 and {m.n_dropped for m in maps} == {1, 2}
