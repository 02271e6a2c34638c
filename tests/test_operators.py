"""Hand-worked cases and invariants."""

import json
import math

import pytest
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions import vectors as V
from quillstream.operators import answering, blocks, incremental, metrics, quality, retrieval, structure
from quillstream.plans import queries
from quillstream.session import Settings, required
from quillstream.sources import files
from quillstream.streaming import telemetry


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(expr.alias("x")).first()["x"]


def hits_of(spark, grades):
    return spark.createDataFrame([(1, f"d{i}", i) for i in range(1, len(grades) + 1)], "qid long, doc_id string, rank long"), spark.createDataFrame([(1, f"d{i}", g) for i, g in enumerate(grades, 1) if g], "qid long, doc_id string, grade long")


def test_metrics_by_hand(spark):
    row = metrics.retrieval_metrics(*hits_of(spark, [2, 0, 1]), (3,)).first()
    assert (row.recall, row.hit, row.mrr) == (1.0, 1.0, 1.0)
    assert row.precision == pytest.approx(2 / 3, abs=1e-6)
    assert row.ndcg == pytest.approx((3 + 1 / 2) / (3 + 1 / math.log2(3)), abs=1e-6)


def test_metrics_without_gold(spark):
    row = metrics.retrieval_metrics(*hits_of(spark, [0, 0]), (1, 3)).where("final_k = 3").first()
    assert (row.recall, row.precision, row.hit, row.mrr, row.ndcg) == (0, 0, 0, 0, 0)


def test_metric_invariants(spark, sf):
    rows = queries.evaluated(spark, sf)
    assert rows.where("ndcg < 0 or ndcg > 1.000001 or recall > 1 or precision > 1").isEmpty()
    wide = rows.groupBy("qid", "level").pivot("final_k", [1, 3, 5, 10]).agg(F.first("recall"))
    assert wide.where("`1` > `3` or `3` > `5` or `5` > `10`").isEmpty()


def test_sections_are_unique_after_dedupe(spark, sf):
    kept = retrieval.first_of_section(queries.bm25_hits(spark, sf))
    assert kept.groupBy("qid", "act", "section").count().where("count > 1").isEmpty()


def test_fusion_is_symmetric(spark, sf):
    a = queries.rt1_bm25_topk(spark, sf)
    b = queries.rt2_vector_topk(spark, sf).withColumnRenamed("vec_id", "doc_id")
    assert sorted(retrieval.fuse([a, b], 5).collect()) == sorted(retrieval.fuse([b, a], 5).collect())


def test_strategies(spark, sf):
    docs, vectors = queries.read(spark, sf, "documents"), queries.read(spark, sf, "embeddings")
    args = (docs, vectors, queries.questions(spark, sf), queries.query_vectors(spark, sf), 10)
    assert {s: retrieval.search(s, *args).where("rank > 10").count() for s in ("bm25", "vector", "hybrid_rrf")} == {"bm25": 0, "vector": 0, "hybrid_rrf": 0}
    with pytest.raises(ValueError):
        retrieval.search("other", *args)


def test_bm25_filter_keeps_to_the_act(spark, sf):
    docs = queries.read(spark, sf, "documents").select("doc_id", "text", "lang")
    asked = queries.questions(spark, sf).withColumn("lang", F.lit("fr"))
    found = retrieval.bm25(docs, asked, 5, filters="lang").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.where("lang != 'fr'").isEmpty() and not found.isEmpty()


def test_cosine_of_zero_is_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.8, 0.6])], "a array<float>, b array<float>")
    assert [round(r.x, 6) for r in df.select(V.cosine(F.col("a"), F.col("b")).alias("x")).collect()] == [0.0, 0.8]


def test_text_functions(spark):
    t = F.col("t")
    assert one(spark, T.normalize_text(t), t=" ﬁx​ ") == "fix"
    assert one(spark, T.squeeze(t), t="a \t b") == "a b"
    assert [one(spark, T.approx_tokens(t), t=x) for x in ("", "abcd", "abcde")] == [1, 1, 2]
    assert one(spark, T.approx_tokens_floor0(t), t="") == 0
    assert one(spark, T.join_lines(F.array(F.lit(" a "), F.lit(""), F.lit(", b"), F.lit("c ."))), t="") == "a, b c."
    assert one(spark, T.safe_id(t), t="16-A (b)") == "16_A_b"
    assert one(spark, T.scrub_headers(t, F.array(F.lit("Of Theft (general)"))), t="x  OF  theft (General) y") == "x y"
    assert one(spark, T.context(F.lit("A"), F.lit("I"), F.lit("T"), F.lit("1"), F.lit(None)), t="") == "Act: A\nChapter I — T\nSection 1"
    assert one(spark, T.is_noise(t), t="45 of 1901") and not one(spark, T.is_noise(t), t="45 of them")


def test_joined_lines_keep_the_digits_at_their_ends(spark):
    assert one(spark, T.join_lines(F.array(F.lit(" 0990 "), F.lit("1 x 1"), F.lit(" 22"))), t="") == "0990 1 x 1 22"


def test_pairwise_cosine_compares_ranks(spark):
    hits = spark.createDataFrame([(2, r, r) for r in range(1, 5)], "qid long, rank long, doc_id long")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")  # an id twice, one without vector
    found = {r.final_k: r.avg_cosine for r in metrics.pairwise_cosine(hits, vectors, (1, 2, 3)).collect()}
    assert found == {1: None, 2: 0.0, 3: pytest.approx(3 * 0.5**0.5 / 5, abs=1e-6)}


def test_pack_keeps_order_and_budget(spark, sf):
    rows = queries.lines(spark, sf).select("doc_id", F.col("pos").cast("long").alias("ord"), "text")
    packed = blocks.pack(rows, target=100).join(rows, ["doc_id", "ord"])
    assert packed.count() == rows.count()
    sizes = packed.groupBy("doc_id", "grp").agg(F.sum(F.length("text")).alias("n"), F.count("*").alias("k"))
    assert sizes.where("k > 1 and ceil((n + 2 * (k - 1)) / 4.0) > 100").isEmpty()


def test_split_loses_nothing(spark, sf):
    docs = queries.read(spark, sf, "documents").select("doc_id", "text")
    squeezed = lambda c: F.regexp_replace(c, r"\s+", "")
    pieces = blocks.split_sentences(docs, 100, 150).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda x: x["text"]), "").alias("got"))
    assert docs.join(pieces, "doc_id").where(squeezed(F.col("text")) != squeezed(F.col("got"))).isEmpty()


def test_section_ranges_drop_what_comes_before(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate([None, 5, None, 7, None])], "doc_id long, line_index long, s int")
    assert [r.section for r in structure.section_ranges(rows, F.col("s")).orderBy("line_index").collect()] == [5, 5, 7, 7]


def test_candidates_and_missing_numbers(spark):
    rows = spark.createDataFrame([(1, 1, "7. Text", 1.0, 1.0), (1, 1, "400. Far", 2.0, 1.0), (1, 1, "none", 3.0, 1.0)], "doc_id long, page int, text string, y0 double, x0 double")
    found = structure.candidates(rows)
    assert [r.number for r in found.collect()] == [7]
    assert [r.number for r in quality.missing_numbers(found, "number", 6, 8).orderBy("number").collect()] == [6, 8]


def test_resume(spark):
    source = spark.createDataFrame([(i,) for i in range(10)], "k long")
    done = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (3, "c", 1), (99, "d", 1)], "k long, v string, t long")
    left = incremental.pending(source, done, "k")
    assert left.count() + source.join(done, "k", "left_semi").count() == 10
    assert [r.k for r in incremental.orphans(source, done, "k").collect()] == [99]
    assert incremental.last_of(done, "k", "t").where("k = 1").first().v == "b"


def test_vector_rules_find_bad_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0],), ([float("nan"), 1.0],), ([float("inf"), 1.0],), ([0.0, 0.0],), ([1.0],), (None,)], "embedding array<float>")
    assert {r.rule_id: r.n_bad for r in quality.report(rows, quality.vector_rules(2)).collect()} == {"dq24_missing": 1, "dq24_dimension": 1, "dq24_finite": 2, "dq24_zero": 1}


def test_golden_rules(spark):
    rows = files.golden_questions(spark.createDataFrame([(json.dumps({"questions": [{"id": "a", "act": "x", "query": "q", "gold": [{"section_number": "1", "relevance_grade": 3, "chunk_ids": []}]}, {"id": "", "act": "x", "query": "q", "gold": []}]}),)], "value string"))
    assert {r.rule_id: r.n_bad for r in quality.report(rows, quality.golden_rules()).collect()} == {"id": 1, "act": 0, "query": 0, "gold": 1, "grade": 1, "chunk_ids": 1}


def test_same_order(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "k string, o int")
    b = spark.createDataFrame([("x", 1), ("z", 2), ("y", 3)], "k string, o int")
    assert quality.same_order(a, b, "k", "o").first().n_moved == 2


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"# A\r\nline\rlast")
    assert [r.text for r in files.text_lines(spark, str(tmp_path)).orderBy("pos").collect()] == ["# A", "line", "last"]
    (tmp_path / "c.json").write_text(json.dumps({"chunks": [{"chunk_id": "1"}, {"chunk_id": "2"}]}))
    assert files.json_chunks(spark, str(tmp_path / "c.json")).count() == 2
    assert files.first_existing(spark, str(tmp_path / "no"), str(tmp_path / "a.md")).endswith("a.md")
    with pytest.raises(FileNotFoundError):
        files.first_existing(spark, str(tmp_path / "no"))
    out = str(tmp_path / "out")
    files.write_jsonl(spark.createDataFrame([(1, 0.5)], "a int, b double"), out)
    assert files.jsonl(spark, out, spark.read.json(out).schema).count() == 1
    with pytest.raises(Exception):
        files.write_jsonl(spark.createDataFrame([(1, float("nan"))], "a int, b double"), out)
    files.write_csv(spark.createDataFrame([([1, 2], None)], "a array<int>, b string"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().a == "[1,2]"
    assert files.file_digests(spark, str(tmp_path / "a.md")).first().sha256 == files.sha256(b"# A\r\nline\rlast")
    pdf = tmp_path / "p.pdf"
    pdf.write_bytes(b"two words")
    row = dict(page=1, block_no=0, line_no=0, x0=0.0, y0=0.0, x1=1.0, y1=1.0, font_size=9.0, flags=0, page_width=600.0, page_height=800.0)
    lines = files.pdf_lines(spark, str(tmp_path), lambda content: [row | {"text": w} for w in content.decode().split()])
    assert lines.count() == 2


def test_answering(spark):
    hits = spark.createDataFrame([(1, 1, "BNS", "303", "Theft is taking. More.")], "qid long, rank long, act string, section string, content string")
    asked = answering.context(hits).withColumn("question", F.lit("what"))
    answers = answering.generate(asked)
    assert answers.first().answer == "Theft is taking [BNS §303]"
    failed = answering.generate(asked, lambda q, c: 1 / 0).first()
    assert failed.answer is None and "division" in failed.error
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    waits = []
    assert answering.retried(flaky, 5, waits.append) == 7 and waits == [1.0, 2.0]
    vectors = answering.embed(spark.createDataFrame([("a", "x y"), ("b", "x y")], "chunk_id string, content string"), answering.hashing_embedder(8), "hash", 8).collect()
    assert vectors[0].embedding == vectors[1].embedding and vectors[0].embedding_dimensions == 8
    scores = {k.split()[0]: 2 for k in answering.JUDGE_SCHEMA.split(", ")[:9]} | {"overall_note": "", "error_tags": []}
    assert answering.judge(asked.withColumn("answer", F.lit("x")), lambda q, a, c: scores).first().groundedness == 2
    assert answering.paragraphs(spark.createDataFrame([(1, "- one\n\ntwo")], "qid long, answer string")).where("bullet").count() == 1


def test_stream_counts_equal_batch(spark, sf, tmp_path):
    batch = queries.read(spark, sf, "events")
    batch.write.parquet(str(tmp_path / "in"))
    stream = telemetry.daily_stream(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("daily").start()
    q.processAllAvailable()
    q.stop()
    want = batch.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, want.collect()))


def test_settings(spark):
    assert Settings.of(spark).final_k == 5
    with pytest.raises(ValueError):
        Settings(candidate_k=1)
    with pytest.raises(KeyError):
        required(spark, "quillstream.absent")
    assert Settings().snapshot(spark).count() == 1
    assert files.embedding_schema()["act"].metadata["facetable"]


def test_entry_works(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
