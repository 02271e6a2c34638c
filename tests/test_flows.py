"""Sinks, sources and flows that have no table to be compared on."""

import pytest
from pyspark.sql import functions as F

from quillstream.operators import answering, incremental, markdown, quality, retrieval, structure
from quillstream.scratch import fits, small
from quillstream.sources import files


def test_results_come_back_as_pair_and_as_csv(spark, tmp_path):
    rows = spark.createDataFrame([(1, "é § x", [1, 2]), (2, None, [])], "id long, text string, l array<int>")
    folder = f"file://{tmp_path}"
    files.write_both(rows, f"{folder}/out")
    files.write_jsonl(rows.select("id"), f"{folder}/summary")
    detail, summary = files.result_pair(spark, f"{folder}/out/jsonl", f"{folder}/summary")
    assert detail.count() == 2 and summary.count() == 2 and spark.read.parquet(f"{folder}/out/parquet").count() == 2
    assert any("§" in p.read_text(encoding="utf-8") for p in (tmp_path / "out/jsonl").glob("*.json"))
    files.regenerate_csv(spark, f"{folder}/out/jsonl", f"{folder}/summary", f"{folder}/csv")
    assert sorted(r.id for r in spark.read.option("header", True).csv(f"{folder}/csv/detail").collect()) == ["1", "2"]
    files.write_text(spark.createDataFrame([("a",)], "x string"), f"{folder}/text")
    assert spark.read.text(f"{folder}/text").first()[0] == "a"
    with pytest.raises(FileNotFoundError):
        files.result_pair(spark, f"{folder}/none", f"{folder}/summary")
    files.write_jsonl(rows.where("false"), f"{folder}/empty")
    with pytest.raises(ValueError, match="empty"):
        files.result_pair(spark, f"{folder}/empty", f"{folder}/summary")


def test_pdf_markdown_by_a_converter(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF hello")
    (tmp_path / "b.txt").write_bytes(b"no")
    got = files.pdf_markdown(spark, f"file://{tmp_path}", lambda raw: "# " + raw.decode()[5:]).collect()
    assert [r.markdown for r in got] == ["# hello"]


def test_embeddings_and_search_documents_are_checked(spark):
    good = spark.createDataFrame([(*["x"] * 12, [1.0, 2.0])], [*files.CHUNK_FIELDS, "embedding"])
    assert files.checked_embeddings(good, 2).schema["embedding"].dataType.elementType.typeName() == "float"
    assert files.search_documents(good, 2).columns == [*files.CHUNK_FIELDS, "content_vector"]
    with pytest.raises(ValueError, match="wrong_dimension"):
        files.checked_embeddings(good, 3)
    with pytest.raises(ValueError, match="act"):
        files.search_documents(good.drop("act"), 2)
    with pytest.raises(Exception, match="wrong size"):
        files.search_documents(good, 3).collect()


def test_answers_with_a_filter_and_without_hits(spark):
    hits = spark.createDataFrame([(1, 1, "Nyaya", "5", "First. Second."), (2, 1, "Nyaya", "6", "x")], "qid long, rank long, act string, section string, content string")
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "qid long, text string")

    def generator(question: str, grounded: str) -> str:
        if question == "b":
            raise RuntimeError("ResponsibleAIPolicyViolation")
        return "Yes [BNS §5]"

    got = {r.qid: r for r in answering.answer(hits, asked, generator).collect()}
    assert (got[1].final_answer, got[1].citations, got[1].status) == ("Yes [BNS §5]", "[BNS §5]", "success")
    assert got[2].content_filtered and got[2].final_answer == answering.FILTERED and got[2].sources_shown == 1
    assert got[3].insufficient and got[3].sources_shown == 0


def test_replay_asks_only_what_is_open(spark):
    asked = spark.createDataFrame([(1, "a", "all"), (2, "b", "bns"), (3, "c", "x")], "qid long, text string, act string")

    def ask(text: str, act: str) -> str:
        if act == "x":
            raise RuntimeError("down")
        return text + act

    got = {r.qid: (r.answer, r.error) for r in answering.replay(asked, asked.where("qid = 1"), ask, attempts=1).collect()}
    assert got == {2: ("bbns", None), 3: (None, "down")}


def test_request_columns(spark):
    rows = spark.range(2).select(*answering.request_columns()).collect()
    assert len({r.request_id for r in rows}) == 2 and rows[0].requested_at is not None


def test_settled_polls_until_the_keys_agree(spark):
    states = iter([spark.range(3), spark.range(5)])
    assert incremental.settled(spark.range(5), spark.range(2), "id", tries=4, wait=0, again=lambda: next(states))
    assert not incremental.settled(spark.range(5), spark.range(2), "id", tries=2, wait=0)


def test_question_subset_names_unknown_ids(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b")], "qid long, text string")
    with pytest.raises(ValueError, match="9"):
        retrieval.question_subset(asked, ids=(1, 9))
    assert retrieval.question_subset(asked).count() == 2


def test_vector_search_by_grid_equals_broadcast(spark, monkeypatch):
    rows = spark.range(60).select(F.col("id").alias("vec_id"), F.array(*[((F.col("id") * k) % 11 - 5).cast("float") for k in (1, 3, 7)]).alias("embedding"))
    asked = rows.where("vec_id % 5 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    whole = sorted(retrieval.vector(rows, asked, 4).collect())
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    monkeypatch.setattr(retrieval, "fits", lambda df: False)
    assert sorted(retrieval.vector(rows, asked, 4).collect()) == whole


def test_vector_search_by_blocks_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BEST", (3, 7))
    monkeypatch.setattr(retrieval, "EVERY", (4, 5))
    rows = [(i, [float((i % 30 * k) % 11 - 5) for k in (1, 3, 7)], "ab"[i % 2] if i % 9 else None) for i in range(60)]  # every vector twice
    rows += [(60, None, "a"), (61, [1.0, None, 2.0], "b"), (62, [1.0, 2.0], "a"), (63, [0.0, 0.0, 0.0], "b"), (64, [], "a"), (65, [1.0, float("nan"), 0.0], "a"), (65, [3e38, 3e38, 3e38], "b")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, lang string")
    asked = vectors.where("vec_id % 5 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"), "lang")
    for by in (None, "lang"):
        plain = retrieval._plain(vectors, asked, by)
        for found, want in ((retrieval.scored(vectors, asked, by), plain), (retrieval.vector(vectors, asked, 4, by).drop("rank"), retrieval.ranked(plain, 4, key="vec_id").drop("rank"))):
            assert found.columns == want.columns and sorted(map(str, found.collect())) == sorted(map(str, want.collect()))


def test_strict_sequence_and_required_rows(spark):
    numbers = spark.createDataFrame([(1,), (2,), (2,), (5,)], "number long")
    assert sorted(tuple(r) for r in quality.sequence_report(numbers, 1, 3).collect()) == [("duplicate", 2), ("missing", 3), ("unexpected", 5)]
    with pytest.raises(ValueError, match="duplicate 2"):
        quality.sequence_report(numbers, 1, 3, strict=True)
    with pytest.raises(ValueError, match="no units"):
        quality.non_empty(numbers.where("false"), "units")
    assert quality.non_empty(numbers, "units") is numbers and "act" in quality.missing_fields(numbers)
    assert quality.number_span(numbers.where("false"), "number") == (0, -1)


def test_a_section_without_lines_ends_where_it_starts(spark):
    starts = spark.createDataFrame([(1, 1, 2, 1.234, 2.0, 3.0, 4.0)], "doc_id long, section long, page int, x0 double, y0 double, x1 double, y1 double")
    none = spark.createDataFrame([], "doc_id long, section long, line_index long, page int, x0 double, y0 double, x1 double, y1 double, text string")
    got = structure.section_records(none, starts, none.select("doc_id", "section", "text")).first()
    assert got.text == "" and got.end == got.start and got.start.x0 == 1.23 and got.pages == [] and got.n_lines == 0


def test_markdown_is_normalized_and_counted(spark):
    text = "# The Act\n# Chapter I - Start\n## Section 1 - First\n(1) words\n\n\n## Schedule\nform\n## PREAMBLE\nWhereas".split("\n")
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "doc_id long, pos long, text string")
    docs, counts = markdown.normalize_files(lines, spark.createDataFrame([(1, "The Act", None)], "doc_id long, title string, act_number string"))
    shown = docs.first().markdown
    assert shown.startswith("# The Act\n\n## Preamble\n\nWhereas\n\n# Chapter I — Start\n\n## Section 1 — First") and shown.rstrip().endswith("form") and "---\n\n## Schedule" in shown
    assert counts.first()[1:] == (1, 1)


def test_sizes_are_checked_in_rows_and_bytes(spark):
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("s"))
    assert fits(wide) and not fits(wide, rows=9) and not fits(wide, most=9_000)
    assert "broadcast" in small(wide)._jdf.queryExecution().logical().toString().lower()
