"""Operators on small rows whose results were worked by hand, or are computed by SQL over the same rows."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import citations as C
from quillstream.functions import text as T
from quillstream.operators import answering, blocks, markdown, metrics, structure
from quillstream.sources import files
from tests import fixtures as X
from tests.conftest import Oracle


def wn4_greedy_sequence(spark):
    return structure.resolve_sequence(structure.candidate_positions(X.frame(spark, X.CANDIDATES)), 1, 7)


def jn2_note_association(spark):
    found = structure.associate_notes(X.frame(spark, X.GROUPS), X.frame(spark, X.SECTIONS))
    return found.select("doc_id", F.col("page").cast("long").alias("page"), "gid", F.col("section").cast("long").alias("section"), "method", "confidence")


def jn4_asof_chapter(spark):
    return structure.chapters_of(X.frame(spark, X.SECTIONS), X.frame(spark, X.CHAPTERS)).withColumn("section", F.col("section").cast("long"))


def wn7_lookahead_titles(spark):
    return structure.detect_chapters(X.frame(spark, X.TITLES))


def wn17_blank_collapse(spark):
    return structure.clean_blank_lines(X.frame(spark, X.BLANKS)).select("doc_id", F.col("pos").cast("long").alias("pos"), "text")


def sf8_classify_lines(spark):
    return X.frame(spark, X.CLASSIFY).select("id", T.classify(F.col("text")).alias("c")).select("id", "c.*")


def wn9_logical_blocks(spark):
    return blocks.logical_blocks(X.frame(spark, X.STRUCT)).drop("first_pos", "last_pos", "n_lines")


def wn10_chunk_blocks(spark):
    return blocks.chunk_blocks(X.frame(spark, X.UNIT))


def sf14_normalize_lines(spark):
    return X.frame(spark, X.CANON).select("id", T.canonical_line(F.col("text")).alias("line"), F.array_join(T.source_pages(F.col("text")).cast("array<string>"), ",").alias("pages"))


def sf21_chunk_ids(spark):
    return blocks.chunks(X.frame(spark, X.PACKED))


def sf26_citations(spark):
    return _answers(spark).select("qid", F.posexplode(C.extracted(F.col("answer"))).alias("pos", "citation")).select("qid", F.col("pos").cast("long").alias("pos"), "citation")


def gn3_enforce(spark):
    return answering.enforce(_answers(spark)).withColumn("final_answer", F.md5("final_answer"))


def ev11_deterministic(spark):
    return metrics.deterministic(_answers(spark))


def src8_golden_flatten(spark):
    return files.golden_keys(files.golden_questions(X.frame(spark, X.GOLDEN)))


def rp1_neighbours(spark):
    found = structure.candidate_positions(X.frame(spark, X.CANDIDATES))
    return structure.neighbours(found, structure.resolve_sequence(found, 1, 7)).select("doc_id", F.col("number").cast("long").alias("number"), "pos")


def _answers(spark: SparkSession) -> DataFrame:
    rows = X.frame(spark, X.ANSWERS)
    for c in ("allowed", "retrieved", "gold", "direct"):
        rows = rows.withColumn(c, F.filter(F.split(c, ";"), lambda x: x != ""))
    return rows.withColumn("n_docs", F.size("allowed"))


def wn8_normalized_sections(spark):
    return markdown.normalized(X.frame(spark, X.MARKDOWN)).withColumn("pages", F.array_join(F.coalesce("pages", F.array().cast("array<int>")).cast("array<string>"), ","))


def wn8_units(spark):
    return markdown.units(X.frame(spark, X.UNIT_LINES)).withColumn("lines", F.array_join("lines", "|")).drop("note")


_ANSWERS = X.values(X.ANSWERS[1], "qid, answer, allowed, retrieved, gold, direct")
_CITED = rf"""an AS (SELECT *, list_filter(string_split(allowed, ';'), lambda x: x <> '') AS al FROM {_ANSWERS}),
ci AS (SELECT *, list_transform(regexp_extract_all(answer, '\[(?:BNS|ICA)\s+§[0-9A-Za-z-]+\]'), lambda c: regexp_replace(c, '\s+', ' ')) AS every FROM an),
cc AS (SELECT *, list_filter(every, lambda x, i: list_position(every, x) = i) AS cited FROM ci),
cu AS (SELECT *, list_filter(cited, lambda c: NOT list_contains(al, c)) AS bad, list_filter(cited, lambda c: list_contains(al, c)) AS good FROM cc)"""

SQL = {
    "wn4_greedy_sequence": f"""WITH RECURSIVE c AS (SELECT doc_id, number, row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, x0) - 1 AS pos FROM {X.values(X.CANDIDATES[1], "doc_id, number, page, y0, x0")}),
r AS (SELECT doc_id, 0::BIGINT AS number, '' AS status, NULL::BIGINT AS pos, -1::BIGINT AS prev FROM (SELECT DISTINCT doc_id FROM c)
  UNION ALL SELECT r.doc_id, r.number + 1, CASE o.n WHEN 0 THEN 'missing-candidate' WHEN 1 THEN 'selected' ELSE 'duplicate-candidates' END, o.p, coalesce(o.p, r.prev)
  FROM r, LATERAL (SELECT count(*) AS n, min(c.pos) AS p FROM c WHERE c.doc_id = r.doc_id AND c.number = r.number + 1 AND c.pos > r.prev) o WHERE r.number < 7)
SELECT doc_id, number, status, pos FROM r WHERE number > 0""",
    "jn2_note_association": f"SELECT doc_id, page, gid, section, method, confidence::DOUBLE AS confidence FROM {X.values(X.NOTES, 'doc_id, page, gid, section, method, confidence')}",
    "jn4_asof_chapter": f"""WITH s AS (SELECT doc_id, page, number FROM {X.values(X.SECTIONS[1], "doc_id, page, number, y0")}), c AS (SELECT * FROM {X.values(X.CHAPTERS[1], "doc_id, page, y, chapter")})
SELECT doc_id, number AS section, (SELECT arg_max(chapter, page * 10000 + y) FROM c WHERE c.doc_id = s.doc_id AND c.page <= s.page) AS chapter FROM s""",
    "wn7_lookahead_titles": f"SELECT * FROM {X.values(X.TITLED, 'doc_id, line_index, number, title')}",
    "wn17_blank_collapse": "SELECT * FROM (VALUES (1, 2, 'a'), (1, 3, ''), (1, 5, 'b'), (1, 6, 'c'), (1, 7, ''), (1, 8, 'd')) AS t(doc_id, pos, text)",
    "sf8_classify_lines": f"SELECT * FROM {X.values(X.CLASSIFIED, 'id, kind, marker, content')}",
    "wn9_logical_blocks": f"SELECT * FROM {X.values(X.BLOCKS, 'doc_id, section, ord, kind, marker, parent_type, parent_marker, text')}",
    "wn10_chunk_blocks": f"SELECT * FROM {X.values(X.UNIT_BLOCKS, 'unit, ord, marker, content_type, direct, text')}",
    "sf14_normalize_lines": f"SELECT * FROM {X.values(X.CANONICAL, 'id, line, pages')}",
    "sf21_chunk_ids": f"SELECT * FROM {X.values(X.CHUNKS, 'chunk_id, section, subsection, content_type, content, citation_text')}",
    "sf26_citations": f"WITH {_CITED} SELECT qid, unnest(range(0, len(cited))) AS pos, unnest(cited) AS citation FROM cu",
    "gn3_enforce": f"""WITH {_CITED}, x AS (SELECT *, len(bad) > 0 OR len(al) = 0 OR starts_with(lower(answer), 'i could not retrieve relevant legal provisions') OR contains(lower(answer), 'retrieved evidence is insufficient') OR contains(lower(answer), 'cannot provide a grounded answer') AS insufficient FROM cu)
SELECT qid, md5(CASE WHEN len(bad) > 0 THEN 'I could not provide a grounded answer from the supplied legal evidence because the generated response contained a citation that was not among the retrieved sources.' ELSE answer END) AS final_answer,
  CASE WHEN insufficient THEN '' ELSE array_to_string(good, ';') END AS citations, array_to_string(bad, ';') AS unsupported, insufficient, CASE WHEN insufficient THEN 0 ELSE len(al) END AS sources_shown FROM x""",
    "ev11_deterministic": rf"""WITH {_CITED}, y AS (SELECT *, list_filter(string_split(retrieved, ';'), lambda x: x <> '') AS r, list_distinct(list_filter(string_split(gold, ';'), lambda x: x <> '')) AS g, list_distinct(list_filter(string_split(direct, ';'), lambda x: x <> '')) AS dg, trim(regexp_replace(answer, '\[[A-Z]+\s+§[0-9A-Za-z-]+\]', '', 'g')) <> '' AS has FROM cu)
SELECT qid, CASE WHEN len(g) = 0 THEN 1.0::DOUBLE ELSE round_even(len(list_intersect(r, g)) / len(g), 4) END AS gold_section_coverage, CASE WHEN len(dg) = 0 THEN 1.0::DOUBLE ELSE round_even(len(list_intersect(r, dg)) / len(dg), 4) END AS direct_gold_coverage,
  list_has_all(r, dg) AS all_direct_gold_retrieved, array_to_string(cited, ';') AS citations, array_to_string(bad, ';') AS unsupported_citations, len(bad) = 0 AS citation_syntax_valid, len(bad) = 0 AS all_citations_from_retrieved_sources,
  len(cited) AS citation_count, has AS has_substantive_answer_text, has AND len(cited) > 0 AS has_citation_with_answer FROM y""",
    "src8_golden_flatten": f"SELECT * FROM {X.values(X.GOLDEN_KEYS, 'qid, chunk_id, grade')}",
    "rp1_neighbours": f"""WITH c AS (SELECT doc_id, number, row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, x0) - 1 AS pos FROM {X.values(X.CANDIDATES[1], "doc_id, number, page, y0, x0")}),
m AS (SELECT * FROM (VALUES (1, 5), (1, 6), (2, 3), (2, 4), (2, 5), (2, 6), (2, 7)) AS t(doc_id, n)) SELECT doc_id, number, pos FROM c WHERE EXISTS (SELECT 1 FROM m WHERE m.doc_id = c.doc_id AND abs(m.n - c.number) <= 2)""",
    "wn8_normalized_sections": f"SELECT * FROM {X.values(X.NORMALIZED, 'doc_id, ord, owner, chapter, number, title, note, pages, body')}",
    "wn8_units": f"SELECT * FROM {X.values(X.UNITS, 'doc_id, unit, number, title, chapter, chapter_title, special, lines')}",
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_worked_cases(spark, name):
    df = globals()[name](spark)
    names = sorted(df.columns)
    want = duckdb.connect().execute(f"SELECT {', '.join(names)} FROM ({SQL[name]})").fetchall()
    plain = lambda rows: sorted((tuple(Oracle._plain(x) for x in r) for r in rows), key=str)
    assert plain(tuple(r[n] for n in names) for r in df.collect()) == plain(want)
