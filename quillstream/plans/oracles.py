"""The queries in SQL, for DuckDB over the same tables."""

from __future__ import annotations

from quillstream.functions import text as T
from quillstream.operators import answering, metrics
from quillstream.operators import markdown as M

_TOK = r"list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
_APPROX = "greatest(1, ceil(length({}) / 4.0))::BIGINT"

_BM25 = f"""
qt AS (SELECT DISTINCT item_id AS qid, unnest({_TOK.format("text")}) AS term FROM benchmark),
tk AS (SELECT doc_id, {_TOK.format("text")} AS toks FROM documents),
st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM tk),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM tk) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bs AS (SELECT qid, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM tf JOIN df USING (term) JOIN qt USING (term) CROSS JOIN st GROUP BY qid, doc_id),
br AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM bs)"""
_COS = "CASE WHEN list_dot_product({a}::DOUBLE[], {a}::DOUBLE[]) * list_dot_product({b}::DOUBLE[], {b}::DOUBLE[]) = 0 THEN 0 ELSE list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[]))) END"
_VEC = f"""
vs AS (SELECT q.vec_id AS qid, v.vec_id, round({_COS.format(a="v.embedding", b="q.embedding")}, 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0),
vr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM vs)"""
_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents"
_PLACED = f"""
p0 AS (SELECT *, (pos // 40 + 1)::BIGINT AS page, 20.0 + 19 * (pos % 40) AS y0, CASE WHEN pos % 5 = 3 THEN 500.0 WHEN pos % 7 = 4 THEN 20.0 ELSE 120.0 END AS x0 FROM ({_LINES})),
p1 AS (SELECT doc_id, text, pos, page, y0::DOUBLE AS y0, x0::DOUBLE AS x0, (x0 + CASE WHEN pos % 7 = 4 THEN 80.0 ELSE 90.0 END)::DOUBLE AS x1, (y0 + 12)::DOUBLE AS y1 FROM p0),
pl AS (SELECT *, CASE WHEN y0 < 800 * 0.055 THEN 'header' WHEN y1 > 800 * (1 - 0.055) THEN 'footer'
  WHEN CASE WHEN page % 2 = 1 THEN x0 >= 600 - 600 * 0.19 ELSE x1 <= 600 * 0.19 END THEN 'margin' ELSE 'body' END AS region FROM p1)"""
_GOLD = """
gold AS (SELECT item_id AS qid, doc_id, CASE WHEN contains(d.text, b.text) THEN 2 ELSE 1 END AS grade FROM documents d JOIN benchmark b ON contains(d.text, string_split(b.text, '.')[1]))"""
_HITS = "hits AS (SELECT br.qid, br.doc_id, br.rank, d.lang AS act, d.source AS section FROM br JOIN documents d USING (doc_id) WHERE rank <= {k})"
_EVAL = (
    "WITH "
    + ", ".join((_BM25, _GOLD, _HITS.format(k=10)))
    + """,
dd AS (SELECT qid, act || '|' || section AS key, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, act, section ORDER BY rank) AS nth FROM hits) WHERE nth = 1),
lv AS (SELECT 'chunk' AS level, qid, doc_id::VARCHAR AS key, rank FROM hits UNION ALL SELECT 'section', qid, key, rank FROM dd),
gl AS (SELECT 'chunk' AS level, qid, doc_id::VARCHAR AS key, doc_id AS o, max(grade) AS grade FROM gold GROUP BY ALL
  UNION ALL SELECT 'section', qid, lang || '|' || source, NULL, max(grade) FROM gold JOIN documents USING (doc_id) GROUP BY ALL),
ks AS (SELECT unnest([1, 3, 5, 10]) AS final_k),
cut AS (SELECT l.level, l.qid, final_k, rank, coalesce(grade, 0) AS grade FROM lv l JOIN ks ON rank <= final_k LEFT JOIN gl g ON g.level = l.level AND g.qid = l.qid AND g.key = l.key),
got AS (SELECT level, qid, final_k, count(*) AS n, count(*) FILTER (grade > 0) AS relevant, min(rank) FILTER (grade > 0) AS first, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM cut GROUP BY ALL),
pg AS (SELECT *, row_number() OVER (PARTITION BY level, qid ORDER BY grade DESC, o, key) AS place FROM gl),
ng AS (SELECT level, qid, count(*) AS n_gold FROM gl GROUP BY ALL),
best AS (SELECT level, qid, n, sum((pow(2, grade) - 1) / log2(place + 1)) AS idcg FROM (SELECT DISTINCT level, qid, n FROM got) JOIN pg USING (level, qid) WHERE place <= n GROUP BY ALL),
ev AS (SELECT level, qid, final_k, CASE WHEN n_gold IS NULL THEN 0.0::DOUBLE ELSE round(least(relevant / n_gold, 1.0), 6) END AS recall, round(relevant / n, 6) AS precision, CASE WHEN relevant > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, round(coalesce(dcg / idcg, 0), 6) AS ndcg
  FROM got LEFT JOIN ng USING (level, qid) LEFT JOIN best USING (level, qid, n))"""
)
#: Means in whole millionths, half up, as the order of additions must not show.
_MEAN = "((2 * sum(round({0} * 1e6)::BIGINT) + count({0})) // (2 * count({0})))::DOUBLE / 1e6"
_MEANS = ", ".join(f"{_MEAN.format(m)} AS {m}" for m in metrics.MEANS)


def _report(source: str, rules: dict[str, str], key: str = "rule_id", n: str = "n_bad", passed: bool = True) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS {key}, count(*) FILTER ({bad}) AS {n}{f', count(*) FILTER ({bad}) = 0 AS passed' if passed else ''} FROM {source}" for name, bad in rules.items())


_CHUNKS = """(SELECT doc_id::VARCHAR AS chunk_id, text AS content, 'provision' AS content_type, CASE WHEN doc_id % 97 <> 0 THEN source END AS section_number,
  CASE WHEN doc_id % 13 = 0 THEN '(' || lang || ') (' || lang || ')' END AS subsection, source || CASE WHEN doc_id % 11 = 0 THEN '(1)' ELSE '' END AS citation_text FROM documents)"""
_EMPTY = "coalesce(trim({}), '') = ''"


def _pack_sql(lists: str, gap: int, target: int) -> str:
    """The greedy packing as a recursion over each document's pieces."""
    return f"""WITH RECURSIVE src AS ({lists}),
fold AS (SELECT doc_id, l, 1 AS i, l[1] AS len, 1::BIGINT AS grp FROM src WHERE len(l) > 0
  UNION ALL SELECT doc_id, l, i + 1, CASE WHEN ceil((len + {gap} + l[i + 1]) / 4.0) > {target} THEN l[i + 1] ELSE len + {gap} + l[i + 1] END, CASE WHEN ceil((len + {gap} + l[i + 1]) / 4.0) > {target} THEN grp + 1 ELSE grp END FROM fold WHERE i < len(l))"""


ORACLES = {
    "snk9_index_update": f"WITH {_BM25.replace('FROM documents)', 'FROM documents WHERE doc_id % 11 <> 4)')} SELECT qid, doc_id, rank, score FROM br WHERE rank <= 10",
    "rt1_bm25_topk": f"WITH {_BM25} SELECT qid, doc_id, rank, score FROM br WHERE rank <= 10",
    "rt2_vector_topk": f"WITH {_VEC} SELECT qid, vec_id, rank, score FROM vr WHERE rank <= 10",
    # the exact best: what the graph finds on tables of this size, and 0.99 of which on larger ones
    "rt2_graph_topk": f"WITH {_VEC} SELECT qid, vec_id, rank, score FROM vr WHERE rank <= 10",
    "rt3_hybrid_rrf": f"""WITH {_BM25}, {_VEC},
every AS (SELECT qid, doc_id, rank FROM br WHERE rank <= 10 UNION ALL SELECT qid // 50, vec_id, rank FROM vr WHERE rank <= 10),
f AS (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM every GROUP BY ALL)
SELECT qid, doc_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 5""",
    "rt7_facets": "SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source",
    "rt9_document_count": "SELECT count(*) AS n FROM documents",
    "flt6_prefilter_vector": f"""WITH s AS (SELECT q.vec_id AS qid, v.vec_id, dv.lang, round({_COS.format(a="v.embedding", b="q.embedding")}, 6) AS score
FROM embeddings v JOIN documents dv ON dv.doc_id = v.vec_id, embeddings q JOIN documents dq ON dq.doc_id = q.vec_id WHERE q.vec_id % 50 = 0 AND dv.lang = dq.lang)
SELECT qid, vec_id, lang, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "wn15_section_dedupe": f"""WITH {_BM25}, {_HITS.format(k=20)}
SELECT qid, doc_id, act, section, row_number() OVER (PARTITION BY qid ORDER BY rank) AS section_rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, act, section ORDER BY rank) AS nth FROM hits) WHERE nth = 1""",
    "ev6_cosine": f"SELECT q.vec_id AS qid, v.vec_id, round({_COS.format(a='v.embedding', b='q.embedding')}, 6) AS cosine FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0",
    "ev7_pairwise_cosine": f"""WITH {_VEC}, h AS (SELECT qid, rank, embedding, unnest([1, 3, 5, 10]) AS final_k FROM vr JOIN embeddings e USING (vec_id) WHERE rank <= 10),
p AS (SELECT a.qid, a.final_k, round(avg({_COS.format(a="a.embedding", b="b.embedding")}), 6) AS avg_cosine FROM h a JOIN h b ON a.qid = b.qid AND a.final_k = b.final_k AND a.rank < b.rank WHERE a.rank <= a.final_k AND b.rank <= b.final_k GROUP BY ALL)
SELECT g.qid, g.final_k, avg_cosine FROM (SELECT DISTINCT qid, final_k FROM h WHERE rank <= final_k) g LEFT JOIN p USING (qid, final_k)""",
    "ev8_unique_redundancy": f"""WITH {_BM25}, {_HITS.format(k=10)}, ks AS (SELECT unnest([1, 3, 5, 10]) AS final_k)
SELECT qid, final_k, round(count(DISTINCT act || '|' || section) / count(*), 6) AS unique_ratio, round(1 - count(DISTINCT act || '|' || section) / count(*), 6) AS redundancy FROM hits JOIN ks ON rank <= final_k GROUP BY ALL""",
    "ag1_metric_summary": f"{_EVAL} SELECT 'bm25' AS strategy, 10::BIGINT AS candidate_k, final_k, level, count(*) AS question_count, {_MEANS} FROM ev GROUP BY final_k, level",
    "ag2_judge_summary": """SELECT metric, round_even(avg(v), 4) AS mean, round_even(100.0::DOUBLE * sum(v) / count(*), 2) AS pct, count(*) AS n, count(*) FILTER (v = 0) AS zeros
FROM (SELECT 'quality' AS metric, quality::DOUBLE AS v FROM labels UNION ALL SELECT 'toxic', toxic::DOUBLE FROM labels) WHERE v IS NOT NULL GROUP BY metric""",
    "ag5_duplicates": "SELECT md5(text) AS text_hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "ag6_uniqueness": "SELECT count(*) AS n, count(DISTINCT doc_id) AS n_distinct, count(*) = count(DISTINCT doc_id) AS is_unique FROM documents",
    "ag7_content_histogram": f"SELECT source, count(*) AS n, max({_APPROX.format('text')}) AS max_tokens, sum({_APPROX.format('text')})::BIGINT AS total_tokens FROM documents GROUP BY source",
    "ag8_vector_stats": "SELECT round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, count(*) FILTER (x <> 0) AS nonzero, count(*) AS total FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings)",
    "ag9_bbox": f"WITH {_PLACED} SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(text, ' ' ORDER BY y0, x0, text) AS text FROM pl WHERE region = 'margin' GROUP BY doc_id, page",
    "ag15_daily_requests": "SELECT ts::DATE AS day, event_id, count(*) OVER (PARTITION BY ts::DATE ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS requests_today FROM events",
    "ag16_cost": f"""SELECT conv_id, round(coalesce(sum({_APPROX.format("text")}) FILTER (role <> 'assistant'), 0) / 1e6 * 0.4 + coalesce(sum({_APPROX.format("text")}) FILTER (role = 'assistant'), 0) / 1e6 * 1.6 + 0.0001, 8) AS cost FROM conversations GROUP BY conv_id""",
    "flt1_noise_lines": rf"""SELECT doc_id, pos, regexp_matches(text, '{T.PAGE_NUMBER}') OR regexp_matches(text, '{T.LEGISLATIVE_REFERENCE}') AS noise FROM ({_LINES})
WHERE regexp_matches(text, '{T.PAGE_NUMBER}') OR regexp_matches(text, '{T.LEGISLATIVE_REFERENCE}') OR regexp_matches(text, '(?i)^\W*\w{{1,4}}\W*$')""",
    "flt2_margin_split": f"WITH {_PLACED} SELECT region, count(*) AS n, round(sum((y0 + y1) / 2), 2) AS sum_center FROM pl GROUP BY region",
    "flt9_upper_ratio": rf"""WITH l AS (SELECT doc_id, pos, text, len(regexp_extract_all(text, '\p{{Lu}}')) AS u, len(regexp_extract_all(text, '\p{{L}}')) AS a FROM ({_LINES}))
SELECT doc_id, pos, round(u / a, 6) AS ratio FROM l WHERE a > 0 AND u / a >= 0.8 AND NOT regexp_matches(text, '{T.SECTION_START}') AND NOT regexp_matches(text, '{T.CHAPTER_LINE}')""",
    "wn1_line_index": f"WITH {_PLACED} SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, x0, pos) - 1 AS line_index FROM pl",
    "wn5_forward_fill_sections": f"""WITH {_PLACED}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, x0, pos) - 1 AS line_index FROM pl),
f AS (SELECT *, last_value(CASE WHEN length(text) % 7 = 3 THEN line_index END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_index ROWS UNBOUNDED PRECEDING) AS section FROM n)
SELECT doc_id, section, min(line_index) AS first_line, max(line_index) AS last_line, sum(length(text))::BIGINT AS n_chars FROM f WHERE section IS NOT NULL GROUP BY ALL""",
    "wn6_margin_groups": f"""WITH {_PLACED}, g AS (SELECT *, sum(CASE WHEN length(text) % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y0, x0 ROWS UNBOUNDED PRECEDING)::BIGINT AS gid FROM pl WHERE region = 'margin'),
t AS (SELECT *, max(gid) OVER (PARTITION BY doc_id, page) AS top FROM g)
SELECT doc_id, page, gid, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(text, ' ' ORDER BY y0, x0, text) AS text FROM t WHERE gid > 0 OR top = 0 GROUP BY ALL""",
    "jn1_nearest_margin": f"""WITH {_PLACED}, a AS (SELECT doc_id, page, pos AS number, y0 + 7 AS y0 FROM pl WHERE region = 'body' AND pos % 6 = 0),
j AS (SELECT a.doc_id, a.number, m.y0 AS margin_y0, row_number() OVER (PARTITION BY a.doc_id, a.page, a.number ORDER BY abs(a.y0 - m.y0), m.y0, m.x0) AS nth FROM a JOIN pl m ON m.region = 'margin' AND m.doc_id = a.doc_id AND m.page = a.page AND abs(a.y0 - m.y0) <= 14)
SELECT doc_id, number, margin_y0 FROM j WHERE nth = 1""",
    "wn11_pack_tokens": _pack_sql(f"SELECT doc_id, list(length(text) ORDER BY pos) AS l FROM ({_LINES}) GROUP BY doc_id", 2, 100) + " SELECT doc_id, grp, count(*) AS n_blocks, sum(l[i])::BIGINT AS n_chars FROM fold GROUP BY doc_id, grp",
    "wn12_sentence_split": _pack_sql(
        rf"SELECT doc_id, s, list_transform(s, lambda x: length(x)) AS l FROM (SELECT doc_id, CASE WHEN {_APPROX.format('text')} <= 150 THEN [text] ELSE string_split(regexp_replace(text, '([.!?;])\s+', '\1' || chr(1), 'g'), chr(1)) END AS s FROM documents)", 1, 100
    ).replace("SELECT doc_id, l, 1 AS i", "SELECT doc_id, s, l, 1 AS i").replace("SELECT doc_id, l, i + 1", "SELECT doc_id, s, l, i + 1")
    + f", m AS (SELECT doc_id, grp AS piece, string_agg(s[i], ' ' ORDER BY i) AS text FROM fold GROUP BY doc_id, grp) SELECT doc_id, piece, md5(text) AS hash, {_APPROX.format('text')} AS tokens FROM m",
    "sf29_context": f"""WITH {_BM25}, {_HITS.format(k=5)}, x AS (SELECT qid, string_agg('SOURCE ' || rank || chr(10) || '[' || act || ' §' || section || ']' || chr(10) || text || chr(10) || '---', chr(10) ORDER BY rank) AS c FROM hits JOIN documents USING (doc_id) GROUP BY qid)
SELECT qid, md5(c) AS context_hash, length(c) AS n_chars FROM x""",
    "dq_rules": _report(_CHUNKS, {
        "dq11_keys": "chunk_id IS NULL OR content IS NULL", "dq13_content": _EMPTY.format("content"), "dq14_section": f"{_EMPTY.format('section_number')} AND content_type NOT IN ('preamble', 'related_judgements', 'schedule')", "dq15_citation": _EMPTY.format("citation_text"),
        "dq16_nested_subsection": r"regexp_matches(subsection, '\)\s*\(')", "dq17_chapter_heading": r"regexp_matches(content, '(?im)^#\s+Chapter\b')", "dq18_separator": r"regexp_matches(content, '(?m)^\s*---+\s*$')", "dq19_marginal_notes": r"len(regexp_extract_all(content, '\*\*Marginal note:\*\*')) > 1",
        "dq20_tokens": "(length(content) + 3) // 4 > 650", "dq21_citation_suffix": rf"regexp_matches(citation_text, '\([^)]+\)$') AND {_EMPTY.format('subsection')}"}),
    "dq24_vectors": _report("embeddings", {"dq24_missing": "embedding IS NULL", "dq24_dimension": "len(embedding) <> 64", "dq24_finite": "len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0", "dq24_zero": "len(list_filter(embedding, lambda x: x <> 0)) = 0"}),
    "dq3_missing_numbers": "SELECT r AS doc_id FROM (SELECT unnest(range(min(doc_id), max(doc_id) + 1)) AS r FROM documents) WHERE r NOT IN (SELECT doc_id FROM labels)",
    "dq9_repeated_lines": f"SELECT trim(text) AS text, count(*) AS n FROM ({_LINES}) WHERE regexp_matches(text, '(?i)licen[cs]e') GROUP BY 1 HAVING count(*) > 2",
    "dq10_garbage": _report(f"({_LINES})", {f"garbage_{i + 1}": f"regexp_matches(text, '{p}')" for i, p in enumerate(T.GARBAGE)}, "pattern", "n", False),
    "dq7_section_sizes": "SELECT doc_id, CASE WHEN length(trim(text)) = 0 THEN 'empty' WHEN length(trim(text)) < 80 THEN 'tiny' ELSE 'giant' END AS finding FROM documents WHERE length(trim(text)) < 80 OR length(trim(text)) > 25000",
    "dq29_request_validation": "SELECT conv_id, turn, length(text) BETWEEN 1 AND 4000 AND conv_id % 3 < 2 AS valid FROM conversations",
    "jn6_preservation": """WITH c AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN upper(text) ELSE text END AS text, CASE WHEN doc_id % 8 <> 0 THEN lang END AS lang, source FROM documents WHERE doc_id % 10 <> 7),
j AS (SELECT d.text IS DISTINCT FROM c.text AS t, d.lang IS DISTINCT FROM c.lang AS l, d.source IS DISTINCT FROM c.source AS s FROM documents d JOIN c USING (doc_id))
SELECT 'text' AS field, count(*) FILTER (t) AS n_changed FROM j UNION ALL SELECT 'lang', count(*) FILTER (l) FROM j UNION ALL SELECT 'source', count(*) FILTER (s) FROM j""",
    "jn7_key_difference": "SELECT CASE WHEN doc_id % 10 = 7 THEN 'missing' ELSE 'extra' END AS side, doc_id AS id FROM documents WHERE doc_id % 10 IN (3, 7)",
    "inc2_pending": "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "inc3_orphans": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "snk8_upsert": "SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 9 WHEN doc_id % 3 = 0 THEN 7 ELSE quality END::INTEGER AS quality, toxic FROM labels UNION ALL SELECT -doc_id - 1, quality, toxic FROM labels WHERE doc_id % 6 = 1",
    "st2_symmetric_diff": "SELECT 'missing' AS side, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id * 3 FROM embeddings) UNION ALL SELECT 'extra', vec_id * 3 FROM embeddings WHERE vec_id * 3 NOT IN (SELECT doc_id FROM documents)",
    "st3_intersection": "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels",
    "snk4_csv_shape": "SELECT doc_id::VARCHAR AS doc_id, '[' || quality || ',' || toxic || ']' AS pair, CASE WHEN doc_id % 2 = 0 THEN quality::VARCHAR ELSE '' END AS maybe FROM labels",
    "snk10_markdown": r"""WITH r AS (SELECT doc_id // 50 AS d, doc_id AS o, lang, source, text, lag(lang) OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) IS DISTINCT FROM lang AS emit FROM documents)
SELECT d AS doc_id, md5(regexp_replace(string_agg(CASE WHEN emit THEN '# Chapter ' || lang || chr(10) || chr(10) ELSE '' END || '## Section ' || source || ' — ' || lang || chr(10) || chr(10) || text || chr(10), chr(10) ORDER BY o), '\n{3,}', chr(10) || chr(10), 'g')) AS hash FROM r GROUP BY d""",
    "rp3_metric_table": f"{_EVAL} SELECT final_k, level, {', '.join(f'''coalesce(format('{{:.4f}}', round_even({_MEAN.format(m)}, 4)), 'N/A') AS {m}''' for m in metrics.MEANS)} FROM ev GROUP BY final_k, level",
    "jn12_grid": "SELECT strategy, candidate_k, final_k, count(*) AS n FROM benchmark, (VALUES ('bm25'), ('vector'), ('hybrid_rrf')) s(strategy), (VALUES (10::BIGINT), (20), (50)) c(candidate_k), (VALUES (1::BIGINT), (3), (5), (10)) f(final_k) WHERE final_k <= candidate_k GROUP BY ALL",
    "gn6_label_map": f"WITH {_BM25}, {_HITS.format(k=10)} SELECT qid, '[' || act || ' §' || section || ']' AS label, arg_max(doc_id, rank) AS doc_id FROM hits GROUP BY ALL",
    "prj4_source_cards": f"WITH {_BM25}, {_HITS.format(k=3)} SELECT qid, rank, doc_id::VARCHAR AS source_id, '[' || act || ' §' || section || ']' AS citation, section AS section_number, md5(left(text, 500)) AS content FROM hits JOIN documents USING (doc_id)",
}
_RUBRIC = ", ".join(f"CASE WHEN judge_status = 'success' THEN (doc_id + {n}) * {n + 3} % 3 END AS {m}" for n, m in enumerate(metrics.RUBRIC))
_ANSWERED = f"""e0 AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'content_filtered' ELSE 'success' END AS status, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 'content_filtered' ELSE 'success' END AS judge_status, doc_id % 4 = 1 AS unsupported FROM labels),
e AS (SELECT *, {_RUBRIC} FROM e0)"""
_NOTES = f"""{_PLACED}, n0 AS (SELECT *, sum(CASE WHEN length(text) % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y0, x0 ROWS UNBOUNDED PRECEDING)::BIGINT AS gid FROM pl WHERE region = 'margin'),
n1 AS (SELECT *, max(gid) OVER (PARTITION BY doc_id, page) AS top FROM n0),
g AS (SELECT doc_id, page, gid, (min(y0) + max(y1)) / 2 AS center FROM n1 WHERE gid > 0 OR top = 0 GROUP BY ALL),
s AS (SELECT doc_id, page, pos AS number, y0 AS y, lead(y0) OVER (PARTITION BY doc_id, page ORDER BY y0) AS following, min(y0) OVER (PARTITION BY doc_id, page) AS first FROM pl WHERE region = 'body' AND pos % 12 = 0),
j AS (SELECT g.doc_id, g.page, g.gid, center, s.number, s.y, first, abs(center - s.y) AS d, center >= s.y - 28 AND (following IS NULL OR center < following - 28) AS inside FROM g LEFT JOIN s USING (doc_id, page)),
per AS (SELECT doc_id, page, gid, arg_min(number, y) FILTER (inside) AS own, arg_min(d, y) FILTER (inside) AS own_d, arg_min(number, d) FILTER (d <= 28) AS near, min(d) FILTER (d <= 28) AS near_d, count(number) AS n, coalesce(max(center) < max(first), false) AS above FROM j GROUP BY ALL),
act AS (SELECT p.doc_id, p.page, p.gid, arg_max(s.number, s.page * 100000 + s.y) AS active FROM per p JOIN s ON s.doc_id = p.doc_id AND s.page < p.page GROUP BY ALL),
m AS (SELECT *, CASE WHEN near IS NOT NULL THEN 'same-page-section-start-alignment' WHEN own IS NOT NULL THEN 'same-page-section-interval' WHEN n > 0 AND above AND active IS NOT NULL THEN 'previous-page-active-section' WHEN n = 0 AND active IS NOT NULL THEN 'continuation-page-active-section' END AS method FROM per LEFT JOIN act USING (doc_id, page, gid)),
notes AS (SELECT doc_id, page, gid, CASE WHEN near IS NOT NULL THEN near WHEN own IS NOT NULL THEN own WHEN method IS NOT NULL THEN active END AS section, method,
  round(CASE WHEN near IS NOT NULL THEN greatest(0, 1 - near_d / 28.0) WHEN own IS NOT NULL THEN greatest(0, 1 - own_d / 56.0) WHEN method = 'previous-page-active-section' THEN 0.7 WHEN method IS NOT NULL THEN 0.65 END, 4)::DOUBLE AS confidence FROM m)"""
_LABELS = f"""{_BM25}, {_HITS.format(k=5)}, lh AS (SELECT qid, doc_id, rank, CASE WHEN act = 'en' THEN '[BNS §' ELSE '[ICA §' END || doc_id % 7 || ']' AS label FROM hits)"""
_DECIMAL = "CASE WHEN {0} = floor({0}) THEN {0}::BIGINT::VARCHAR || '.0' ELSE {0}::VARCHAR END"
ORACLES |= {
    "ev10_grid": f"""WITH {_BM25}, {_VEC}, {_GOLD}, ck AS (SELECT unnest([10, 20, 50])::BIGINT AS candidate_k),
hl AS (SELECT 'bm25' AS strategy, candidate_k, qid, doc_id, rank FROM br JOIN ck ON rank <= candidate_k UNION ALL SELECT 'vector', candidate_k, qid // 50, vec_id, rank FROM vr JOIN ck ON rank <= candidate_k),
hf AS (SELECT candidate_k, qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM hl GROUP BY ALL),
hits AS (SELECT * FROM hl UNION ALL SELECT 'hybrid_rrf', candidate_k, qid, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY candidate_k, qid ORDER BY score DESC, doc_id) AS rank FROM hf) WHERE rank <= candidate_k),
ks AS (SELECT unnest([1, 3, 5, 10]) AS final_k),
cut AS (SELECT strategy, candidate_k, h.qid, final_k, rank, coalesce(grade, 0) AS grade FROM hits h JOIN ks ON rank <= final_k LEFT JOIN gold g ON g.qid = h.qid AND g.doc_id = h.doc_id),
got AS (SELECT strategy, candidate_k, qid, final_k, count(*) AS n, count(*) FILTER (grade > 0) AS relevant, min(rank) FILTER (grade > 0) AS first, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM cut GROUP BY ALL),
pg AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, doc_id) AS place FROM gold), ng AS (SELECT qid, count(*) AS n_gold FROM gold GROUP BY ALL),
best AS (SELECT qid, n, sum((pow(2, grade) - 1) / log2(place + 1)) AS idcg FROM (SELECT DISTINCT qid, n FROM got) JOIN pg USING (qid) WHERE place <= n GROUP BY ALL),
ev AS (SELECT strategy, candidate_k, final_k, CASE WHEN n_gold IS NULL THEN 0.0::DOUBLE ELSE round(least(relevant / n_gold, 1.0), 6) END AS recall, round(relevant / n, 6) AS precision, CASE WHEN relevant > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, round(coalesce(dcg / idcg, 0), 6) AS ndcg
  FROM got LEFT JOIN ng USING (qid) LEFT JOIN best USING (qid, n))
SELECT strategy, candidate_k, final_k, 'chunk' AS level, count(*) AS question_count, {_MEANS} FROM ev GROUP BY ALL""",
    "flt7_projection": f"WITH {_BM25}, {_HITS.format(k=5)} SELECT qid, rank, score, lang AS act, d.source AS section_number, md5(text) AS content, d.doc_id::VARCHAR AS chunk_id FROM br JOIN documents d USING (doc_id) WHERE rank <= 5",
    "flt8_question_subset": "SELECT item_id AS qid, md5(text) AS hash FROM benchmark WHERE item_id IN (1, 3, 17) UNION ALL SELECT * FROM (SELECT item_id, md5(text) FROM benchmark ORDER BY item_id LIMIT 2)",
    "rt8_listing": "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 1000",
    "so4_smoke_search": f"""WITH {_BM25}, {_VEC}, every AS (SELECT qid, doc_id, rank FROM br WHERE rank <= 20 UNION ALL SELECT qid // 50, vec_id, rank FROM vr WHERE rank <= 20),
f AS (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM every GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM f)
SELECT qid, rank, doc_id, md5(left(text, 500)) AS content FROM o JOIN documents USING (doc_id) WHERE rank <= 5""",
    "so6_samples": "SELECT source, count(*) AS n, array_to_string(list(doc_id ORDER BY doc_id)[1:10], ',') AS sample FROM documents GROUP BY source",
    "dq28_too_many": f"WITH {_BM25}, {_HITS.format(k=5)} SELECT qid, count(*) AS n FROM hits GROUP BY qid HAVING count(*) > 3",
    "ag3_answer_flags": f"""WITH {_ANSWERED} SELECT count(*) AS n, count(*) FILTER (quality <> 1) AS direct_gold_not_fully_retrieved, count(*) FILTER (status = 'success' AND unsupported) AS unsupported_citations, count(*) FILTER (hallucination = 2) AS material_hallucination, count(*) FILTER (answer_correctness = 0) AS correctness_zero,
count(*) FILTER (groundedness = 0) AS groundedness_zero, count(*) FILTER (status = 'content_filtered') AS generation_content_filtered, count(*) FILTER (status = 'success') AS generation_successful, count(*) FILTER (judge_status = 'content_filtered') AS judge_content_filtered, count(*) FILTER (judge_status = 'success') AS judge_successful FROM e""",
    "ag4_split_means": f"WITH {_ANSWERED} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, CASE WHEN quality = 1 THEN 'sufficient' ELSE 'insufficient' END AS \"group\", round_even(avg({m}), 4) AS mean, count(*) AS n FROM e WHERE {m} IS NOT NULL GROUP BY ALL" for m in metrics.RUBRIC),
    "dq1_sequence": """WITH h AS (SELECT min(doc_id) AS lo, max(doc_id) AS hi FROM documents), x AS (SELECT doc_id - CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 50 = 1 THEN hi + 1 ELSE 0 END AS number FROM labels, h)
SELECT 'missing' AS finding, r AS number FROM (SELECT unnest(range(lo, hi + 1)) AS r FROM h) WHERE r NOT IN (SELECT number FROM x) UNION ALL SELECT DISTINCT 'unexpected', number FROM x, h WHERE number NOT BETWEEN lo AND hi
UNION ALL SELECT 'duplicate', number FROM x GROUP BY number HAVING count(*) > 1""",
    "dq4_duplicate_sections": "SELECT lang AS doc_id, upper(source) AS section, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1",
    "dq26_totals": """SELECT *, n = expected AS passed FROM (SELECT 'sections_en' AS "check", count(DISTINCT source) FILTER (lang = 'en') AS n, 358::BIGINT AS expected FROM documents UNION ALL SELECT 'chapters', count(DISTINCT lang), 4 FROM documents UNION ALL SELECT 'chunks', count(*), 642 FROM documents UNION ALL SELECT 'questions', count(*), 40 FROM benchmark)""",
    "dq23_missing_fields": "SELECT doc_id::VARCHAR AS chunk_id, 'section_number' AS missing FROM documents WHERE doc_id % 13 = 0 AND doc_id % 97 = 0",
    "ag14_roll_up": """WITH c AS (SELECT source, count(*) FILTER (length(text) = 0) = 0 AS c1, max(n_chars) < 15000 AS c2, count(DISTINCT lang) = 1 AS c3 FROM documents GROUP BY source),
e AS (SELECT source AS doc_id, ((NOT c1)::INT + (NOT c2)::INT + (NOT c3)::INT)::BIGINT AS n_failed, c1 AND c2 AND c3 AS passed FROM c) SELECT * FROM e UNION ALL SELECT NULL, sum(n_failed)::BIGINT, bool_and(passed) FROM e""",
    "wn21_order": "WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS pa, row_number() OVER (ORDER BY CASE WHEN doc_id % 10 = 3 THEN doc_id + 5 ELSE doc_id END, doc_id) AS pb FROM documents) SELECT count(*) FILTER (pa <> pb) AS n_moved FROM a",
    "sf30_candidates": rf"""WITH {_PLACED}, c0 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, x0, pos) - 1 AS line_index, pos * 7 % 400 AS number, (pos * 7 % 400) || '. ' || text AS t FROM pl),
c AS (SELECT *, number BETWEEN 1 AND 358 AS ok, length(trim(text)) >= 3 AS a, x0 / 600 BETWEEN 0.05 AND 0.75 AS b, y0 BETWEEN 800 * 0.055 AND 800 * (1 - 0.055) AS c FROM c0 WHERE pos % 6 = 0),
r AS (SELECT *, CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence, CASE WHEN ok THEN list_filter(['strict-section-syntax', CASE WHEN a THEN 'has-section-text' END, CASE WHEN b THEN 'broad-body-x-position' END, CASE WHEN c THEN 'body-y-position' END], lambda x: x IS NOT NULL) ELSE ['outside-BNS-section-range'] END AS reason FROM c)
SELECT doc_id, line_index, confidence, array_to_string(reason, ',') AS reason, md5('{{"number":' || number || ',"page":' || page || ',"line_index":' || line_index || ',"bbox":[' || {_DECIMAL.format("x0")} || ',' || {_DECIMAL.format("y0")} || ',' || {_DECIMAL.format("x1")} || ',' || {_DECIMAL.format("y1")} || '],"text":' || to_json(t)::VARCHAR || ',"confidence":' || {_DECIMAL.format("confidence")} || ',"reason":' || to_json(reason)::VARCHAR || '}}') AS json FROM r""",
    "rp2_section_records": rf"""WITH {_PLACED}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, x0, pos) - 1 AS line_index FROM pl),
f AS (SELECT *, last_value(CASE WHEN length(text) % 7 = 3 THEN line_index END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_index ROWS UNBOUNDED PRECEDING) AS section, trim(regexp_replace(regexp_replace(text, '{T.INVISIBLE}', '', 'g'), '[ 	]+', ' ', 'g'), ' ') AS clean FROM n),
st AS (SELECT doc_id, section, page, y0 FROM f WHERE section = line_index),
b AS (SELECT doc_id, section, coalesce(string_agg(clean, chr(10) ORDER BY line_index) FILTER (clean <> ''), '') AS text, array_to_string(list_sort(list_distinct(list(page))), ',') AS pages, arg_max(page, line_index) AS page, arg_max(y0, line_index) AS y, count(*) AS n FROM f WHERE section IS NOT NULL AND region = 'body' GROUP BY ALL),
t AS (SELECT doc_id, section, string_agg(text, '|' ORDER BY text) AS notes FROM f WHERE section IS NOT NULL AND region = 'margin' GROUP BY ALL)
SELECT doc_id, section, md5(coalesce(b.text, '')) AS text, coalesce(b.pages, '') AS pages, st.y0 AS start_y, coalesce(b.page, st.page) AS end_page, coalesce(b.y, st.y0) AS end_y, md5(coalesce(notes, '')) AS notes, coalesce(n, 0) AS n_lines FROM st LEFT JOIN b USING (doc_id, section) LEFT JOIN t USING (doc_id, section)""",
    "jn3_notes_of_lines": f"WITH {_NOTES} SELECT * FROM notes",
    "dq30_unassociated": f"WITH {_NOTES} SELECT doc_id, page, gid, 'unassociated-margin-note' AS warning FROM notes WHERE section IS NULL",
    "ag13_note_counts": f"WITH {_NOTES} SELECT doc_id, count(*) AS n_notes, count(section) AS n_associated, count(*) - count(section) AS n_unassociated FROM notes GROUP BY doc_id",
    "prj2_search_documents": f"SELECT chunk_id, md5(content) AS content, citation_text, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS vector_sum, 13::BIGINT AS n_fields FROM {_CHUNKS} c JOIN embeddings e ON e.vec_id::VARCHAR = c.chunk_id",
    "src11_embedding_faults": """WITH r AS (SELECT CASE WHEN vec_id % 50 = 7 THEN ' ' WHEN vec_id % 50 = 8 THEN (vec_id + 1)::VARCHAR ELSE vec_id::VARCHAR END AS chunk_id, vec_id % 50 AS m FROM embeddings)
SELECT chunk_id, CASE m WHEN 7 THEN 'missing_id' WHEN 10 THEN 'missing_vector' ELSE 'wrong_dimension' END AS fault FROM r WHERE m IN (7, 10, 11) UNION ALL SELECT chunk_id, 'duplicate_id' FROM r WHERE m <> 7 GROUP BY chunk_id HAVING count(*) > 1""",
    "rp8_allowed_labels": f"WITH {_LABELS} SELECT qid, string_agg(label, ';' ORDER BY label) AS allowed FROM (SELECT DISTINCT qid, label FROM lh) GROUP BY qid",
    "jn18_linked_citations": f"""WITH {_LABELS}, f AS (SELECT qid, label, arg_min(doc_id, rank) AS doc_id FROM lh GROUP BY ALL), w AS (SELECT DISTINCT qid, label FROM lh WHERE rank <= 2),
o AS (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY label) AS nth FROM w), c AS (SELECT qid, label, CASE WHEN nth = 1 THEN 0 ELSE 2 END AS pos FROM o UNION ALL SELECT DISTINCT qid, '[BNS §99]', 1 FROM w)
SELECT c.qid, pos, c.label AS citation, doc_id FROM c LEFT JOIN f USING (qid, label)""",
    "prj5_judge_payload": f"""WITH {_LABELS}, x AS (SELECT qid, '[' || string_agg('{{"rank":' || rank || ',"citation":"' || label || '","section_number":"' || doc_id % 7 || '","section_title":"' || lang || '","content":"' || md5(text) || '"}}', ',' ORDER BY rank) || ']' AS p FROM lh JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY qid) SELECT qid, md5(p) AS payload FROM x""",
    "gn5_fallback": f"""WITH r AS (SELECT conv_id * 1000 + turn AS qid, text, turn % 3 = 1 AS failed, turn % 3 = 1 AND conv_id % 2 = 0 AS filtered FROM conversations)
SELECT qid, CASE WHEN filtered THEN 'content_filtered' WHEN failed THEN 'error' ELSE 'success' END AS status, filtered AS content_filtered, CASE WHEN filtered THEN md5('{answering.FILTERED}') WHEN NOT failed THEN md5(text) END AS answer FROM r""",
    "snk11_rendered": r"""WITH r AS (SELECT doc_id // 50 AS d, doc_id % 50 AS i, lang, source, md5(text) AS body FROM documents),
p AS (SELECT d, i, CASE i WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 1 THEN 3 ELSE 2 END AS place, chr(10) || chr(10) AS e, CASE WHEN i = 0 THEN body WHEN i = 1 THEN '## Schedule' || e || body WHEN i = 2 THEN '## Related Judgements' || e || body
  WHEN i % 12 = 3 THEN '# Chapter ' || (i - 3) // 12 || ' — ' || CASE WHEN i % 5 <> 4 THEN source ELSE '' END ELSE '## Section ' || i || CASE WHEN i % 5 <> 4 THEN ' — ' || source ELSE '' END || e || CASE WHEN i % 3 = 0 THEN '**Marginal note:** ' || lang || e ELSE '' END || body END
  || CASE WHEN i > 2 AND (i % 12 = 2 OR i = max(i) OVER (PARTITION BY d)) THEN e || '---' ELSE '' END AS part FROM r),
w AS (SELECT d, '# An Act' || e2 || CASE WHEN d % 2 = 0 THEN '**Act number:** 45 OF 2023' || e2 ELSE '' END || string_agg(part, chr(10) || chr(10) ORDER BY place, i) || chr(10) AS m FROM p, (SELECT chr(10) || chr(10) AS e2) GROUP BY d, e2)
SELECT d AS doc_id, md5(regexp_replace(m, '\n{3,}', chr(10) || chr(10), 'g')) AS hash FROM w""".replace("\\n", "\n"),
    "src12_counts": "SELECT count(*) AS n, sum(quality)::BIGINT AS quality, 2::BIGINT AS n_metrics FROM labels",
}
FIRST_NAMES = {
    "wn4_greedy_sequence": "wn4_table_sequence", "jn2_note_association": "jn3_notes_of_lines", "jn4_asof_chapter": "jn4_chapters_of_lines", "wn7_lookahead_titles": "wn7_chapter_titles", "wn17_blank_collapse": "wn17_table_blanks",
    "sf8_classify_lines": "sf8_statute_lines", "wn9_logical_blocks": "wn9_section_blocks", "sf14_normalize_lines": "sf14_statute_lines", "rp1_neighbours": "rp1_table_neighbours",
}
# as in plans.queries, stated anew so that this module stands alone
RAW_HEADS = ("(1) ", "**(2)** ", "Explanation 1 — ", "", "Exception: ", "  ", "**Illustration** ")
CHUNK_HEADS = ("**(1)** ", "**(2)** ", "**(a)** ", "", "**(iv)** ", "**Explanation:** ", "Provided that ", "- **(b)** ", "**Illustration** ", "**(c)**, ", "**(3)** ", "so chapter  II part  II of THINGS, ", "---", "")
SECTION_HEADS = ("(1) ", "(a) ", "Illustrations.", "(2) ", "(3) ", "(b) ", "Explanation 1.—", "", "(iv) ", "Provided that ", "(4) ", "Illustration: ", " (3) ", "(c) ", "Provided further that ", "(5) ")
LINE_HEADS = ("(1) ", "(12)", "(a) ", "(iv) ", "Explanation 2.— ", "Illustrations", "Provided further that ", "", "  (Z) ", "Exception: ", "**(2)** ", "**Explanation** - ", "<!-- source_pages=3, x, 4 -->", "**Illustration**")
_STATUTE = f"sl AS (SELECT doc_id, pos, ([{', '.join(repr(x) for x in LINE_HEADS)}])[(pos % {len(LINE_HEADS)}) + 1] || text AS text FROM ({_LINES}))"
_KINDS = (("subsection", T.SUBSECTION, None), ("subclause", T.SUBCLAUSE, None), ("clause", T.CLAUSE, None), ("explanation", T.EXPLANATION, "Explanation"), ("illustration", T.ILLUSTRATION, "Illustration"), ("proviso", T.PROVISO, "Provided that"))


def _by_kind(value, other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN {value(k, p, m)}" for k, p, m in _KINDS) + f" ELSE {other} END"


def _marker(kind: str, pattern: str, marker: str | None) -> str:
    return repr(marker) if marker else f"('(' || regexp_extract(text, '{pattern}', 1) || ')')"


def _content(kind: str, pattern: str, marker: str | None) -> str:
    return f"regexp_extract(text, '{pattern}', {1 if marker else 2})"


def _shown(head: str, text: str) -> str:
    return f"CASE WHEN trim({text}, ' ') = '' THEN {head} ELSE {head} || ' ' || trim({text}, ' ') END"


_MARKED = _shown(f"'**' || regexp_extract(t, '{T.MD_MARKER}', 1) || '**'", f"regexp_extract(t, '{T.MD_MARKER}', 2)")
_TYPED = " ".join(f"WHEN regexp_matches(t, '{p}') THEN " + _shown(f"'**{n}:**'", f"regexp_extract(t, '{p}', 1)") for n, p in T.MD_TYPES)
_CANONICAL = f"CASE WHEN regexp_matches(t, '{T.MD_MARKER}') THEN {_MARKED} {_TYPED} ELSE t END"
_CANDIDATES = f"""{_PLACED}, c AS (SELECT doc_id, number, row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, x0) - 1 AS pos FROM (SELECT *, pos * 5 // 3 % 13 AS number FROM pl WHERE pos % 3 = 0)),
r AS (SELECT doc_id, 0::BIGINT AS number, '' AS status, NULL::BIGINT AS pos, -1::BIGINT AS prev FROM (SELECT DISTINCT doc_id FROM c)
  UNION ALL SELECT r.doc_id, r.number + 1, CASE o.n WHEN 0 THEN 'missing-candidate' WHEN 1 THEN 'selected' ELSE 'duplicate-candidates' END, o.p, coalesce(o.p, r.prev)
  FROM r, LATERAL (SELECT count(*) AS n, min(c.pos) AS p FROM c WHERE c.doc_id = r.doc_id AND c.number = r.number + 1 AND c.pos > r.prev) o WHERE r.number < 12)"""
ORACLES |= {
    "sf8_statute_lines": f"WITH {_STATUTE} SELECT doc_id, pos, {_by_kind(lambda k, p, m: repr(k), repr('text'))} AS kind, {_by_kind(_marker, 'NULL')} AS marker, md5({_by_kind(_content, 'text')}) AS content FROM sl",
    "sf14_statute_lines": rf"""WITH {_STATUTE}, x AS (SELECT *, trim(text, ' ') AS t FROM sl)
SELECT doc_id, pos, md5({_CANONICAL}) AS line, array_to_string(list_filter(list_transform(string_split(regexp_extract(text, '{T.SOURCE_PAGES}', 1), ','), lambda p: try_cast(trim(p) AS INT)), lambda p: p IS NOT NULL), ',') AS pages FROM x""",
    "wn7_chapter_titles": rf"""WITH l AS (SELECT doc_id, pos AS line_index, CASE WHEN pos % 11 = 0 THEN 'CHAPTER ' || repeat('I', pos // 11 % 3 + 1) WHEN pos % 11 IN (1, 2) AND doc_id % 3 <> 0 THEN upper(replace(text, 'ß', 's')) WHEN pos % 11 = 3 AND doc_id % 2 = 0 THEN 'LAST PART OF TITLE' WHEN pos % 11 = 4 THEN '7. ' || text ELSE lower(text) END AS text FROM ({_LINES})),
k AS (SELECT *, regexp_matches(text, '{T.CHAPTER_LINE}') AS chapter, CASE WHEN regexp_matches(text, '{T.CHAPTER_LINE}') OR regexp_matches(text, '{T.SECTION_START}') THEN 'stop'
  WHEN len(regexp_extract_all(text, '\p{{L}}')) > 0 AND len(regexp_extract_all(text, '\p{{Lu}}')) / len(regexp_extract_all(text, '\p{{L}}')) >= 0.8 THEN 'title' ELSE 'other' END AS kind FROM l),
w AS (SELECT *, list(kind) OVER n AS kinds, list(text) OVER n AS texts FROM k WINDOW n AS (PARTITION BY doc_id ORDER BY line_index ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
s AS (SELECT *, coalesce(list_position(kinds, 'stop'), 99) AS stop, coalesce(list_position(kinds, 'title'), 99) AS head FROM w WHERE chapter),
e AS (SELECT *, coalesce(list_min(list_filter(range(1, 6), lambda i: i > head AND coalesce(kinds[i], 'stop') <> 'title')), 6) AS tail FROM s),
j AS (SELECT doc_id, line_index, upper(regexp_extract(text, '{T.CHAPTER_LINE}', 1)) AS number, CASE WHEN head < stop THEN array_to_string(texts[head:tail - 1], ' ') ELSE '' END AS raw FROM e),
c0 AS (SELECT *, string_split(trim(regexp_replace(raw, '\s+', ' ', 'g'), ' '), ' ') AS x FROM j),
c AS (SELECT *, array_to_string(list_transform(x, lambda w, i: CASE WHEN i = 1 OR (regexp_matches(x[i - 1], '(^|[^\p{{L}}\p{{N}}_])[A-Z]$') AND regexp_matches(w, '^[A-Z]($|[^\p{{L}}\p{{N}}_])')) THEN w ELSE ' ' || w END), '') AS one FROM c0)
SELECT doc_id, line_index, number, nullif(trim(regexp_replace(regexp_replace(one, '\s+([,.;:])', '\1', 'g'), '\s+&\s+', ' & ', 'g'), ' '), '') AS title FROM c""",
    "jn4_chapters_of_lines": f"""WITH {_PLACED}, s AS (SELECT doc_id, page, pos AS section FROM pl WHERE pos % 6 = 0), c AS (SELECT doc_id, page, arg_max('c' || pos, y0) AS chapter FROM pl WHERE pos % 17 = 3 GROUP BY doc_id, page)
SELECT s.doc_id, section, (SELECT arg_max(c.chapter, c.page) FROM c WHERE c.doc_id = s.doc_id AND c.page <= s.page) AS chapter FROM s""",
    "wn4_table_sequence": f"WITH RECURSIVE {_CANDIDATES} SELECT doc_id, number, status, pos FROM r WHERE number > 0",
    "rp1_table_neighbours": f"WITH RECURSIVE {_CANDIDATES}, m AS (SELECT doc_id, number FROM r WHERE status = 'missing-candidate') SELECT doc_id, number, pos FROM c WHERE EXISTS (SELECT 1 FROM m WHERE m.doc_id = c.doc_id AND abs(m.number - c.number) <= 2)",
    "wn17_table_blanks": f"""WITH l AS (SELECT doc_id, pos, CASE WHEN pos % 4 < 2 THEN repeat(' ', (pos % 3)::INT) ELSE text END AS text FROM ({_LINES})), b AS (SELECT *, trim(text, ' ') = '' AS blank FROM l),
w AS (SELECT *, min(pos) FILTER (NOT blank) OVER (PARTITION BY doc_id) AS lo, max(pos) FILTER (NOT blank) OVER (PARTITION BY doc_id) AS hi FROM b), k AS (SELECT *, lag(blank) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM w WHERE pos BETWEEN lo AND hi)
SELECT doc_id, pos, md5(CASE WHEN blank THEN '' ELSE text END) AS text FROM k WHERE NOT (blank AND coalesce(before, false))""",
    "flt4_candidates": f"SELECT doc_id, pos, pos * 37 % 500 AS number FROM ({_LINES}) WHERE pos % 2 = 0 AND pos * 37 % 500 BETWEEN 1 AND 358",
    "flt5_filtered_bm25": f"""WITH {_BM25}, f AS (SELECT bs.*, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM bs JOIN documents USING (doc_id) WHERE lang = CASE WHEN qid % 2 = 0 THEN 'en' ELSE 'fr' END) SELECT qid, doc_id, r AS rank, score FROM f WHERE r <= 5""",
    "sf35_paragraphs": r"""WITH p AS (SELECT conv_id * 1000 + turn AS qid, string_split(replace(trim(replace(text, chr(10), chr(10) || ' ' || chr(10) || '- '), ' '), chr(10) || ' ' || chr(10), chr(1)), chr(1)) AS x FROM conversations), u AS (SELECT qid, unnest(x) AS t, unnest(range(0, len(x))) AS pos FROM p)
SELECT qid, pos, regexp_matches(t, '^\s*[-*•]\s+') AS bullet, md5(regexp_replace(t, '^\s*[-*•]\s+', '')) AS text FROM u""",
    "sf20_contexts": "SELECT doc_id, concat_ws(chr(10), 'Act: ' || lang, 'Chapter ' || CASE WHEN doc_id % 2 <> 0 THEN source END || ' — ' || CASE WHEN doc_id % 3 <> 0 THEN source END, 'Section ' || CASE WHEN doc_id % 5 <> 0 THEN source END, 'Marginal note: ' || CASE WHEN doc_id % 7 <> 0 THEN source END) AS context FROM documents",
    "sf19_scrubbed": rf"SELECT doc_id, pos, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || '  AND (X) tail', '(?i)the\s+of', '', 'g'), '(?i)and\s+\(x\)', '', 'g'), '(?i)de\s+la', '', 'g'), '[ \t]+', ' ', 'g'), ' ')) AS text FROM ({_LINES})",
    "inc1_last_of": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "dq27_golden_rules": _report("benchmark", {"id": "item_id % 9 = 0", "act": "item_id % 7 = 0", "query": "trim(text) = ''", "gold": "item_id % 5 = 0", "grade": "item_id % 5 <> 0 AND (item_id % 3 NOT IN (1, 2) OR item_id % 4 NOT IN (1, 2))", "chunk_ids": "item_id % 5 <> 0 AND item_id % 4 = 0"}),
    "gn1_answers": f"""WITH {_LABELS}, top AS (SELECT qid, string_split(string_split(text, chr(10))[1], '. ')[1] || ' ' || label AS a, label FROM lh JOIN documents USING (doc_id) WHERE rank = 1), n AS (SELECT qid, count(*) AS n FROM lh WHERE rank <= 3 GROUP BY qid)
SELECT b.item_id AS qid, md5(coalesce(a, 'I could not retrieve relevant legal provisions.')) AS final_answer, coalesce(label, '') AS citations, '' AS unsupported, a IS NULL AS insufficient, CASE WHEN a IS NULL THEN 0 ELSE n END AS sources_shown, 'success' AS status, false AS content_filtered
FROM benchmark b LEFT JOIN top ON top.qid = b.item_id LEFT JOIN n ON n.qid = b.item_id""",
    "rp10_log_lines": """SELECT md5('{"doc_id":' || doc_id || ',"quality":' || quality || ',"toxic":' || toxic || '}') AS line FROM labels""",
    "rp13_documents": """WITH r AS (SELECT *, doc_id // 50 AS d, doc_id % 3 = 0 AS chapter FROM documents)
SELECT d AS doc_id, md5('{"sha256":"' || sha256(d::VARCHAR) || '","n_sections":' || count(*) FILTER (NOT chapter) || ',"n_chapters":' || count(DISTINCT lang) || ',"ocr":false,"llm":false,"sections":['
  || string_agg('{"ord":' || doc_id || ',"owner":"' || CASE WHEN chapter THEN 'chapter' ELSE 'section' END || '","chapter":"' || lang || '","number":"' || doc_id || '","title":"' || source || '","pages":[' || doc_id || '],"body":"' || md5(text) || '"}', ',' ORDER BY doc_id) || ']}') AS json FROM r GROUP BY d""",
}
_SECTION_LINES = f"""sl0 AS (SELECT doc_id // 50 AS d, doc_id % 50 // 13 + 1 AS section, doc_id % 50 * 1000000 + pos AS pos, ([{', '.join(repr(x) for x in SECTION_HEADS)}])[(pos * 7 + doc_id * 3 + pos // 5) % {len(SECTION_HEADS)} + 1] || text AS text FROM ({_LINES})),
sl1 AS (SELECT d, section, pos, CASE WHEN row_number() OVER (PARTITION BY d, section ORDER BY pos) = 1 THEN section || ' . ' || text ELSE text END AS text FROM sl0),
sl2 AS (SELECT d, section, pos, row_number() OVER (PARTITION BY d, section ORDER BY pos) AS n, text FROM sl1 WHERE trim(text, ' ') <> ''),
sl AS (SELECT d, section, pos, n, CASE WHEN n = 1 THEN trim(regexp_replace(text, '^\\s*' || section || '\\s*\\.\\s*', ''), ' ') ELSE text END AS text FROM sl2)"""
#: Line by line: what the line is, given what is open, and what is open after it.
_SECTION_BLOCKS = f"""WITH RECURSIVE {_SECTION_LINES},
c AS (SELECT d, section, pos, n, {_by_kind(lambda k, p, m: repr(k), repr('text'))} AS base, {_by_kind(_marker, 'NULL')} AS marker, {_by_kind(_content, 'text')} AS content FROM sl),
w AS (SELECT DISTINCT d, section, 0::BIGINT AS n, 0::BIGINT AS pos, '' AS kind, NULL::VARCHAR AS marker, '' AS content, NULL::VARCHAR AS parent_type, NULL::VARCHAR AS parent_marker, NULL::VARCHAR AS sub, false AS pro, false AS ill, 0::BIGINT AS ord FROM c
  UNION ALL
  SELECT d, section, n, pos, kind, marker, content, CASE WHEN kind = 'illustration_item' THEN 'illustration' WHEN kind IN ('clause', 'subclause') THEN CASE WHEN sub IS NOT NULL THEN 'subsection' WHEN pro THEN 'proviso' END END,
    CASE WHEN kind = 'illustration_item' THEN 'Illustration' WHEN kind IN ('clause', 'subclause') THEN CASE WHEN sub IS NOT NULL THEN sub WHEN pro THEN 'Provided that' END END,
    CASE WHEN kind = 'subsection' THEN marker ELSE sub END, CASE WHEN kind IN ('subsection', 'explanation') THEN false WHEN kind = 'proviso' THEN true ELSE pro END,
    CASE WHEN kind = 'illustration' THEN true WHEN kind IN ('text', 'illustration_item') THEN ill ELSE false END, ord + CASE WHEN kind <> 'text' OR n = 1 THEN 1 ELSE 0 END
  FROM (SELECT c.*, w.sub, w.pro, w.ill, w.ord, CASE WHEN w.ill AND (base IN ('clause', 'subclause') OR base = 'subsection' AND NOT coalesce(regexp_extract(c.marker, '\\d+')::HUGEINT = regexp_extract(w.sub, '\\d+')::HUGEINT + 1, false)) THEN 'illustration_item' ELSE base END AS kind
    FROM w JOIN c ON c.d = w.d AND c.section = w.section AND c.n = w.n + 1))"""
ORACLES["wn9_section_blocks"] = f"""{_SECTION_BLOCKS},
g AS (SELECT d, section, ord, CASE arg_min(kind, n) WHEN 'text' THEN 'section_text' ELSE arg_min(kind, n) END AS kind, arg_min(struct_pack(m := marker), n).m AS marker, arg_min(struct_pack(m := parent_type), n).m AS parent_type, arg_min(struct_pack(m := parent_marker), n).m AS parent_marker,
  coalesce(string_agg(trim(content, ' '), ' ' ORDER BY n) FILTER (trim(content, ' ') <> ''), '') AS text, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n_lines FROM w WHERE n > 0 GROUP BY d, section, ord)
SELECT d AS doc_id, section, ord, kind, marker, parent_type, parent_marker, md5(trim(regexp_replace(text, '\\s+([,.;:!?])', '\\1', 'g'), ' ')) AS text, first_pos, last_pos, n_lines FROM g"""
_HEADS = ", ".join(repr(x) for x in CHUNK_HEADS)
#: From documents to chunks: lines, units, scrubbed lines, blocks line by line, sentences and groups by folds over lengths.
ORACLES["wn10_chunk_build"] = rf"""WITH RECURSIVE src AS (SELECT doc_id // 50 AS d, doc_id % 50 AS i, source, lang, text, (['I', 'II', 'III', 'IV', 'V'])[doc_id % 50 // 12 + 1] AS roman FROM documents),
al AS (SELECT d, i, list_concat(list_filter([CASE WHEN i % 12 = 0 THEN '# Chapter ' || roman || ' — Part ' || roman || ' of things' END, CASE WHEN i % 12 = 0 THEN 'lines of no unit' END,
    CASE WHEN i % 25 = 1 THEN '## Preamble' WHEN i % 25 = 7 THEN '## Schedule' ELSE '## Section ' || i || CASE WHEN i % 9 = 4 THEN '-A' ELSE '' END || CASE WHEN i % 5 <> 4 THEN ' — ' || source ELSE '' END END,
    CASE WHEN i % 3 = 0 THEN '**Marginal note:** ' || lang END], lambda x: x IS NOT NULL), coalesce(list_transform(string_split(text, chr(10)), lambda x, q: ([{_HEADS}])[((q - 1) * 5 + i) % {len(CHUNK_HEADS)} + 1] || x), [])) AS a FROM src),
ml AS (SELECT d, i * 1000000 + p AS pos, text, trim(text, ' ') AS line FROM (SELECT d, i, unnest(a) AS text, unnest(range(0, len(a))) AS p FROM al)),
k AS (SELECT *, CASE WHEN regexp_matches(line, '{T.CHAPTER_HEADING}') THEN 'chapter' WHEN regexp_matches(line, '{T.SECTION_HEADING}') THEN 'section' WHEN regexp_matches(line, '{T.SPECIAL_HEADING}') THEN 'special' END AS kind FROM ml),
r AS (SELECT *, count(*) FILTER (kind IN ('section', 'special')) OVER o AS unit, last_value(kind IGNORE NULLS) OVER o AS open, last_value(CASE WHEN kind = 'chapter' THEN regexp_extract(line, '{T.CHAPTER_HEADING}', 1) END IGNORE NULLS) OVER o AS chapter,
    last_value(CASE WHEN kind = 'chapter' THEN regexp_extract(line, '{T.CHAPTER_HEADING}', 2) END IGNORE NULLS) OVER o AS chapter_title FROM k WINDOW o AS (PARTITION BY d ORDER BY pos ROWS UNBOUNDED PRECEDING)),
notes AS (SELECT d, unit, arg_min(regexp_extract(text, '{T.MARGINAL_NOTE}', 1), pos) AS note FROM r WHERE kind IS NULL AND open <> 'chapter' AND regexp_matches(text, '{T.MARGINAL_NOTE}') GROUP BY d, unit),
heads AS (SELECT d, unit, chapter, chapter_title, CASE WHEN kind = 'section' THEN regexp_extract(line, '{T.SECTION_HEADING}', 1) END AS number, CASE WHEN kind = 'section' THEN regexp_extract(line, '{T.SECTION_HEADING}', 2) ELSE regexp_extract(line, '{T.SPECIAL_HEADING}', 1) END AS title,
    CASE WHEN kind = 'special' THEN lower(regexp_extract(line, '{T.SPECIAL_HEADING}', 1)) END AS special FROM r WHERE kind IN ('section', 'special')),
u AS (SELECT h.*, concat_ws(chr(10), 'Act: Invented Act', 'Chapter ' || chapter || ' — ' || chapter_title, CASE WHEN number IS NOT NULL THEN 'Section ' || number || ' — ' || title ELSE title END, 'Marginal note: ' || note) AS context FROM heads h LEFT JOIN notes USING (d, unit)),
pats AS (SELECT d, list('(?i)\bCHAPTER\s*' || chapter || '\s+Part\s+' || chapter || '\s+of\s+things' ORDER BY pos) AS ps FROM r WHERE kind = 'chapter' GROUP BY d),
b0 AS (SELECT d, unit, pos, trim(regexp_replace(CASE WHEN ps IS NULL THEN text ELSE list_reduce(ps, lambda s, p: regexp_replace(s, p, '', 'g'), text) END, '[ \t]+', ' ', 'g'), ' ') AS line FROM r LEFT JOIN pats USING (d) WHERE kind IS NULL AND open <> 'chapter'),
b1 AS (SELECT *, row_number() OVER (PARTITION BY d, unit ORDER BY pos) AS n, CASE WHEN regexp_matches(line, '{T.BOLD_MARKER}') AND NOT regexp_matches(regexp_extract(line, '{T.BOLD_MARKER}', 2), '^ *[,.;:)]') THEN regexp_extract(line, '{T.BOLD_MARKER}', 1) END AS marker FROM b0 WHERE line NOT IN ('', '---') AND NOT regexp_matches(line, '{T.MARGINAL_NOTE}')),
b AS (SELECT *, CASE WHEN marker IS NULL AND regexp_matches(line, '{T.BOLD_TYPE}') THEN lower(regexp_extract(line, '{T.BOLD_TYPE}', 1)) END AS typ, CASE WHEN regexp_matches(marker, '[0-9]') THEN 'numeric' WHEN length(marker) = 3 THEN 'alpha' WHEN marker IS NOT NULL THEN 'roman' END AS mk FROM b1),
walk AS (SELECT DISTINCT d, unit, 0::BIGINT AS n, NULL::VARCHAR AS top, false AS nested, 0::BIGINT AS ord, false AS direct FROM b
  UNION ALL SELECT b.d, b.unit, b.n, coalesce(w.top, b.mk),
    CASE WHEN b.mk IS NOT NULL THEN CASE WHEN w.top IS NULL OR (w.nested AND b.mk = 'numeric' AND w.top = 'numeric') THEN false ELSE w.nested END WHEN b.typ IS NOT NULL THEN w.nested OR b.typ = 'explanation'
      ELSE w.nested OR starts_with(lower(trim(regexp_replace(b.line, '^\s*\*\*|\*\*\s*$', '', 'g'), ' ')), 'provided that') END,
    w.ord + CASE WHEN b.n = 1 OR b.mk IS NOT NULL OR b.typ IS NOT NULL THEN 1 ELSE 0 END,
    CASE WHEN b.mk IS NULL THEN false WHEN w.top IS NULL THEN true WHEN w.nested THEN b.mk = 'numeric' AND w.top = 'numeric' ELSE b.mk = w.top END
  FROM walk w JOIN b ON b.d = w.d AND b.unit = w.unit AND b.n = w.n + 1),
blk AS (SELECT b.d, b.unit, ord, arg_min(struct_pack(m := marker), b.n).m AS marker, coalesce(arg_min(struct_pack(m := typ), b.n).m, 'provision') AS content_type, arg_min(direct, b.n) AS direct, string_agg(line, chr(10) ORDER BY b.n) AS text FROM b JOIN walk w ON w.d = b.d AND w.unit = b.unit AND w.n = b.n GROUP BY b.d, b.unit, ord),
st AS (SELECT d, unit, ord, unnest(s) AS s, unnest(range(1, len(s) + 1)) AS j FROM (SELECT *, CASE WHEN {_APPROX.format('text')} <= 150 THEN [text] ELSE string_split(regexp_replace(text, '([.!?;])\s+', '\1' || chr(1), 'g'), chr(1)) END AS s FROM blk)),
sf AS (SELECT d, unit, ord, 1::BIGINT AS j, length(s) AS len, 1 AS piece FROM st WHERE j = 1
  UNION ALL SELECT f.d, f.unit, f.ord, st.j, CASE WHEN ceil((f.len + 1 + length(st.s)) / 4.0) > 100 THEN length(st.s) ELSE f.len + 1 + length(st.s) END, f.piece + CASE WHEN ceil((f.len + 1 + length(st.s)) / 4.0) > 100 THEN 1 ELSE 0 END
  FROM sf f JOIN st ON st.d = f.d AND st.unit = f.unit AND st.ord = f.ord AND st.j = f.j + 1),
pc AS (SELECT d, unit, ord, piece, string_agg(s, ' ' ORDER BY j) AS text FROM sf JOIN st USING (d, unit, ord, j) GROUP BY d, unit, ord, piece),
pl AS (SELECT pc.*, row_number() OVER (PARTITION BY d, unit ORDER BY ord, piece) AS n, length(context) + 2 AS base FROM pc JOIN u USING (d, unit)),
pf AS (SELECT d, unit, n, base + length(text) AS len, 1::BIGINT AS grp FROM pl WHERE n = 1
  UNION ALL SELECT f.d, f.unit, p.n, CASE WHEN ceil((f.len + 2 + length(p.text)) / 4.0) > 100 THEN p.base + length(p.text) ELSE f.len + 2 + length(p.text) END, f.grp + CASE WHEN ceil((f.len + 2 + length(p.text)) / 4.0) > 100 THEN 1 ELSE 0 END
  FROM pf f JOIN pl p ON p.d = f.d AND p.unit = f.unit AND p.n = f.n + 1),
it AS (SELECT d, unit, grp, n, marker, content_type, direct, pl.text FROM pf JOIN pl USING (d, unit, n) JOIN blk USING (d, unit, ord)),
fm AS (SELECT d, unit, grp, marker, min(n) AS n FROM it WHERE direct AND marker IS NOT NULL GROUP BY ALL), ms AS (SELECT d, unit, grp, string_agg(marker, ', ' ORDER BY n) AS subsection FROM fm GROUP BY ALL),
ch AS (SELECT d, unit, grp, string_agg(text, chr(10) || chr(10) ORDER BY n) AS body, count(*) AS k, count(DISTINCT content_type) AS types, any_value(content_type) AS typ, any_value(marker) AS marker, bool_and(direct) AS direct FROM it GROUP BY d, unit, grp)
SELECT d AS doc_id, unit, grp AS ordinal, CASE WHEN special IS NOT NULL THEN 'ia-special-' || special || '-c' || grp ELSE 'ia-ch' || lower(coalesce(chapter, 'na')) || '-s' || trim(regexp_replace(number, '[^A-Za-z0-9]+', '_', 'g'), '_') || '-c' || grp END AS chunk_id, 'Invented Act' AS act,
  chapter AS chapter_number, chapter_title, number AS section_number, md5(title) AS section_title, subsection, CASE WHEN special IS NOT NULL THEN special WHEN types = 1 THEN typ ELSE 'mixed' END AS content_type, md5(context || chr(10) || chr(10) || body) AS content,
  CASE WHEN special IS NOT NULL THEN 'Invented Act, ' || title ELSE 'ia §' || number || CASE WHEN k = 1 AND direct AND marker IS NOT NULL AND typ = 'provision' THEN marker ELSE '' END END AS citation_text, 'invented.md' AS source_file, {_APPROX.format("context || chr(10) || chr(10) || body")} AS tokens
FROM ch JOIN u USING (d, unit) LEFT JOIN ms USING (d, unit, grp)"""
_UNIT_ROWS = ORACLES["wn10_chunk_build"].split("notes AS (")[0].replace("WITH RECURSIVE", "WITH").rstrip().rstrip(",")
ORACLES["wn8_units"] = rf"""{_UNIT_ROWS},
x AS (SELECT * FROM r WHERE open <> 'chapter' AND (kind IS NULL OR kind <> 'chapter')),
g AS (SELECT d, unit, max(CASE WHEN kind = 'section' THEN regexp_extract(line, '{T.SECTION_HEADING}', 1) END) AS number, max(CASE kind WHEN 'section' THEN regexp_extract(line, '{T.SECTION_HEADING}', 2) WHEN 'special' THEN regexp_extract(line, '{T.SPECIAL_HEADING}', 1) END) AS title,
  max(chapter) FILTER (kind IS NOT NULL) AS chapter, max(chapter_title) FILTER (kind IS NOT NULL) AS chapter_title, max(CASE WHEN kind = 'special' THEN lower(regexp_extract(line, '{T.SPECIAL_HEADING}', 1)) END) AS special,
  arg_min(regexp_extract(line, '{T.MARGINAL_NOTE}', 1), pos) FILTER (regexp_matches(line, '{T.MARGINAL_NOTE}')) AS note, coalesce(string_agg(text, '|' ORDER BY pos) FILTER (kind IS NULL), '') AS lines FROM x GROUP BY d, unit)
SELECT d AS doc_id, unit, number, coalesce(nullif(title, ''), note, '') AS title, chapter, chapter_title, special, md5(lines) AS lines FROM g"""
_RAW_LINES = rf"""src AS (SELECT doc_id // 50 AS d, doc_id % 50 AS i, source, lang, text, (['I', 'II', 'III', 'IV', 'V'])[doc_id % 50 // 12 + 1] AS roman FROM documents),
al AS (SELECT d, i, list_concat(list_concat(list_filter([CASE WHEN i = 0 THEN '# The Invented Act' END, CASE WHEN i = 0 THEN 'loose words' END, CASE WHEN i % 4 = 2 THEN '<!-- source_pages=3, x, 4 -->' END, CASE WHEN i % 12 = 5 THEN '# CHAPTER ' || roman || ' — Part  ' || roman END,
    CASE WHEN i % 25 = 1 THEN '## PREAMBLE' WHEN i % 25 = 7 THEN '## Schedule' WHEN i % 25 = 13 THEN '## Related Judgements' WHEN i = 2 THEN '## [45 OF 2023]' ELSE '## Section ' || i || CASE WHEN i % 9 = 4 THEN '-A. ' ELSE ' — ' END || CASE WHEN i % 5 <> 4 THEN source || '   of ' || lang ELSE '' END END,
    CASE WHEN i % 3 = 0 THEN '**Marginal note:** ' || lang END], lambda x: x IS NOT NULL),
  coalesce(flatten(list_transform(string_split(text, chr(10)), lambda x, q: CASE WHEN (q - 1) % 4 = 1 THEN ['', ' ', ([{', '.join(repr(x) for x in RAW_HEADS)}])[((q - 1) * 3 + i) % {len(RAW_HEADS)} + 1] || x] ELSE [([{', '.join(repr(x) for x in RAW_HEADS)}])[((q - 1) * 3 + i) % {len(RAW_HEADS)} + 1] || x] END)), [])),
  list_filter([CASE WHEN i % 6 = 0 THEN '**Marginal note:** ' || source END, CASE WHEN i % 10 = 3 THEN '' END], lambda x: x IS NOT NULL)) AS a FROM src),
ml AS (SELECT d, i * 1000000 + p AS pos, rtrim(text, ' ') AS text, trim(text, ' ') AS t FROM (SELECT d, i, unnest(a) AS text, unnest(range(0, len(a))) AS p FROM al))"""
#: The router line by line: what is open, in which chapter, and whether a blank line would be the first after something.
ORACLES["wn8_normalized_sections"] = rf"""WITH RECURSIVE {_RAW_LINES},
k0 AS (SELECT *, CASE WHEN regexp_matches(t, '{T.SOURCE_PAGES}') THEN 'pages' WHEN regexp_matches(text, '{M.ANY_CHAPTER}') THEN 'chapter' WHEN starts_with(text, '# ') THEN 'title' WHEN regexp_matches(text, '{M.ANY_SECTION}') THEN 'section'
  WHEN t IN ('## PREAMBLE', '## Related Judgements', '## Schedule') THEN 'special' WHEN regexp_matches(t, '{M.ACT_NUMBER}') THEN 'act' ELSE 'line' END AS kind FROM ml),
k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY pos) AS n, regexp_matches(text, '{T.MARGINAL_NOTE}') AS noted FROM k0 WHERE kind <> 'title'),
w AS (SELECT DISTINCT d, 0::BIGINT AS n, 0::BIGINT AS ord, '' AS open, NULL::VARCHAR AS chapter, true AS skip, false AS shown, false AS is_note FROM k
  UNION ALL SELECT k.d, k.n, ord + CASE WHEN kind IN ('chapter', 'section', 'special', 'act') THEN 1 ELSE 0 END, CASE WHEN kind IN ('chapter', 'section', 'special', 'act') THEN kind ELSE open END,
    CASE WHEN kind = 'chapter' THEN regexp_extract(text, '{M.ANY_CHAPTER}', 1) ELSE chapter END, kind <> 'line' OR t = '' OR (open = 'section' AND noted), kind = 'line' AND NOT (open = 'section' AND noted) AND NOT (t = '' AND skip), kind = 'line' AND open = 'section' AND noted
  FROM w JOIN k ON k.d = w.d AND k.n = w.n + 1),
x AS (SELECT k.*, w.ord, w.open, w.chapter, w.shown, w.is_note FROM k JOIN w USING (d, n)),
g AS (SELECT d, ord, any_value(CASE WHEN open IN ('section', 'special') THEN open WHEN chapter IS NOT NULL THEN 'chapter' ELSE 'preamble' END) AS owner, max(chapter) AS chapter, max(CASE WHEN kind = 'section' THEN regexp_extract(text, '{M.ANY_SECTION}', 1) END) AS number,
  max(CASE kind WHEN 'section' THEN trim(regexp_replace(regexp_extract(text, '{M.ANY_SECTION}', 2), '\s+', ' ', 'g'), ' ') WHEN 'chapter' THEN trim(regexp_replace(regexp_extract(text, '{M.ANY_CHAPTER}', 2), '\s+', ' ', 'g'), ' ')
    WHEN 'special' THEN CASE t WHEN '## PREAMBLE' THEN 'Preamble' ELSE substr(t, 4) END END) AS heading, arg_min(regexp_extract(text, '{T.MARGINAL_NOTE}', 1), n) FILTER (is_note) AS first_note, arg_max(regexp_extract(text, '{T.MARGINAL_NOTE}', 1), n) FILTER (is_note) AS note,
  arg_max(array_to_string(list_filter(list_transform(string_split(regexp_extract(t, '{T.SOURCE_PAGES}', 1), ','), lambda p: try_cast(trim(p) AS INT)), lambda p: p IS NOT NULL), ','), n) FILTER (kind = 'pages') AS pages,
  coalesce(string_agg({_CANONICAL}, chr(10) ORDER BY n) FILTER (shown), '') AS body FROM x GROUP BY d, ord)
SELECT d AS doc_id, ord, owner, chapter, number, coalesce(nullif(heading, ''), first_note) AS title, note, coalesce(pages, '') AS pages, md5(rtrim(body, ' ')) AS body FROM g"""
ORACLES["rp13_document_records"] = f"""WITH {_NOTES}, dn AS (SELECT doc_id // 50 AS d, doc_id AS r, page, gid, section, method, confidence::DECIMAL(6, 4)::VARCHAR AS confidence FROM notes),
dh AS (SELECT doc_id // 50 AS d, count(*) AS n FROM documents GROUP BY 1),
dc AS (SELECT doc_id // 50 AS d, string_agg('{{"number":' || doc_id || ',"title":"' || lang || '"}}', ',' ORDER BY doc_id) AS j FROM documents WHERE doc_id % 12 = 0 GROUP BY 1),
ds AS (SELECT doc_id // 50 AS d, string_agg('{{"number":' || doc_id || ',"title":"' || source || '","text":"' || md5(text) || '"}}', ',' ORDER BY doc_id) AS j FROM documents WHERE doc_id % 12 <> 0 GROUP BY 1),
dm AS (SELECT d, count(*) AS k, count(section) AS a, string_agg('{{"row":' || r || ',"page":' || page || ',"gid":' || gid || CASE WHEN section IS NULL THEN '' ELSE ',"section":' || section END || CASE WHEN method IS NULL THEN '' ELSE ',"method":"' || method || '"' END
    || CASE WHEN confidence IS NULL THEN '' ELSE ',"confidence":"' || confidence || '"' END || '}}', ',' ORDER BY r, page, gid) AS j,
  string_agg('{{"row":' || r || ',"page":' || page || ',"gid":' || gid || ',"warning":"note ' || gid || ' of page ' || page || ' belongs to no section"}}', ',' ORDER BY r, page, gid) FILTER (section IS NULL) AS w FROM dn GROUP BY d)
SELECT dh.d AS doc_id, md5('{{"document":{{"title":"d' || dh.d || '","page_count":' || dh.n || ',"ocr_used":false}},"chapters":[' || coalesce(dc.j, '') || '],"sections":[' || coalesce(ds.j, '') || '],"marginal_notes":[' || coalesce(dm.j, '') || '],"warnings":[' || coalesce(dm.w, '')
  || '],"diagnostics":{{' || CASE WHEN dm.k IS NULL THEN '' ELSE '"associated":' || dm.a || ',"notes":' || dm.k END || '}}}}') AS json FROM dh LEFT JOIN dc USING (d) LEFT JOIN ds USING (d) LEFT JOIN dm USING (d)"""
_BLOCKS = ORACLES["wn10_chunk_build"].split("st AS (SELECT d, unit, ord, unnest(s)")[0].rstrip().rstrip(",")
ORACLES["wn10_chunk_blocks"] = f"{_BLOCKS} SELECT d AS doc_id, unit, ord, marker, content_type, direct, md5(text) AS text FROM blk"
ORACLES["sf21_chunk_ids"] = f"SELECT chunk_id, doc_id, subsection, content_type, content, citation_text FROM ({ORACLES['wn10_chunk_build']})"
_SAID = rf"""{_LABELS}, la AS (SELECT qid, list_sort(list_distinct(list(label))) AS allowed, list_distinct(list((doc_id % 7)::VARCHAR)) AS retrieved, count(*) AS n, list(label ORDER BY rank) FILTER (rank <= 2) AS said FROM lh GROUP BY qid),
an AS (SELECT item_id AS q, coalesce(allowed, []) AS allowed, coalesce(retrieved, []) AS retrieved, coalesce(n, 0) AS n, list_concat(CASE WHEN said[1] = said[2] THEN said[1:1] ELSE coalesce(said, []) END, CASE WHEN item_id % 3 = 0 THEN ['[ICA §99]'] ELSE [] END) AS cited,
    CASE WHEN item_id % 5 = 0 THEN '' ELSE 'It is so for ' || item_id || ' by ' END || coalesce(array_to_string(said, ' '), '') || CASE WHEN item_id % 3 = 0 THEN ' [ICA  §99]' ELSE '' END || CASE WHEN item_id % 7 = 2 THEN ' The retrieved evidence is insufficient.' ELSE '' END AS answer,
    list_distinct([(item_id % 7)::VARCHAR, ((item_id * 3 + 1) % 7)::VARCHAR]) AS gold, CASE WHEN item_id % 4 = 0 THEN [] ELSE [(item_id % 7)::VARCHAR] END AS direct, item_id % 3 = 0 AS bad, item_id % 5 <> 0 OR item_id % 7 = 2 AS words
  FROM benchmark LEFT JOIN la ON la.qid = item_id)"""
_SHARE = "CASE WHEN len({0}) = 0 THEN 1.0::DOUBLE ELSE round_even(len(list_intersect(retrieved, {0})) / len({0}), 4) END"
ORACLES |= {
    "ev11_deterministic": f"""WITH {_SAID} SELECT q AS qid, {_SHARE.format('gold')} AS gold_section_coverage, {_SHARE.format('direct')} AS direct_gold_coverage, len(list_filter(direct, lambda x: NOT list_contains(retrieved, x))) = 0 AS all_direct_gold_retrieved,
  array_to_string(cited, ';') AS citations, CASE WHEN bad THEN '[ICA §99]' ELSE '' END AS unsupported_citations, NOT bad AS citation_syntax_valid, NOT bad AS all_citations_from_retrieved_sources, len(cited) AS citation_count, words AS has_substantive_answer_text, words AND len(cited) > 0 AS has_citation_with_answer FROM an""",
    "gn3_enforce": f"""WITH {_SAID}, e AS (SELECT *, bad OR n = 0 OR q % 7 = 2 AS lacking FROM an) SELECT q AS qid, md5(CASE WHEN bad THEN '{answering.C.REFUSAL}' ELSE answer END) AS final_answer, CASE WHEN lacking THEN '' ELSE array_to_string(cited, ';') END AS citations,
  CASE WHEN bad THEN '[ICA §99]' ELSE '' END AS unsupported, lacking AS insufficient, CASE WHEN lacking THEN 0 ELSE n END AS sources_shown FROM e""",
    "sf26_citations": f"WITH {_SAID} SELECT q AS qid, unnest(range(0, len(cited))) AS pos, unnest(cited) AS citation, unnest(list_transform(cited, lambda c: regexp_extract(c, '§([0-9]+)', 1))) AS section FROM an",
    "src8_golden_flatten": "SELECT 'q' || item_id AS qid, 'c' || (item_id + x) AS chunk_id, CASE WHEN x = 0 THEN greatest(item_id % 3, item_id % 2) ELSE item_id % 3 END AS grade FROM benchmark, (VALUES (0), (1)) t(x)",
    "src9_golden_faults": """WITH f AS (SELECT item_id AS q, unnest(CASE WHEN item_id % 7 = 0 THEN [item_id % 4, (item_id + 1) % 4] ELSE [item_id % 4] END) AS file FROM benchmark),
p AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY CASE WHEN file % 2 = 0 AND q % 3 = 0 THEN 1 ELSE 0 END, q) - 1 AS pos FROM f)
SELECT file, pos, 'q' || q AS id, 'missing_query' AS fault FROM p WHERE q % 9 = 0 UNION ALL SELECT file, pos, 'q' || q, 'duplicate_id' FROM p WHERE q % 7 = 0""",
}
ORACLES |= {old: ORACLES[new] for old, new in FIRST_NAMES.items()}
ORACLES |= {"ag15_stream": ORACLES["ag15_daily_requests"], "snk8_stream": ORACLES["snk8_upsert"]}
ORACLES |= {f"ev{i}_{m}": f"{_EVAL} SELECT qid, level, final_k, {m} FROM ev" for i, m in enumerate(metrics.MEANS, 1)}
