"""Queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstream.llm import ann_tree, langid, line_dedup, maxscore, minhash, mixing, quotes, repair, sessions, surrogates, toxicity, winnowing, wrappers
from quillstream.llm.common import table

_LOWER_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_tree.search_report(table(spark, sf_dir, "embeddings"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)
    return found.selectExpr("doc_id", "n_shingles", "component_id", "doc_id = component_id as kept")


def op3_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(table(spark, sf_dir, "documents"))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_report(table(spark, sf_dir, "documents"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessionise(table(spark, sf_dir, "clicks"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


def op13_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.search_report(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_ann_tree": op1_ann_tree,
    "op2_minhash": op2_minhash,
    "op3_quotes": op3_quotes,
    "op4_toxicity": op4_toxicity,
    "op5_wrappers": op5_wrappers,
    "op6_mixing": op6_mixing,
    "op7_surrogates": op7_surrogates,
    "op8_line_dedup": op8_line_dedup,
    "op9_langid": op9_langid,
    "op10_winnowing": op10_winnowing,
    "op11_sessions": op11_sessions,
    "op12_repair": op12_repair,
    "op13_maxscore": op13_maxscore,
}

ORACLES = {
    "op8_line_dedup": f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, pos, line, {_LOWER_AZ.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM docs)),
frequent AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.doc_id, l.pos, l.line, f.keeper IS NOT NULL AND f.keeper <> l.doc_id AS gone FROM lines l LEFT JOIN frequent f USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op10_winnowing": f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER_AZ.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array({_LOWER_AZ.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, list_slice(w, i, i + least(len(w), 10) - 1) AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, list_slice(w, i, i + m - 1) AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)),
hits AS (SELECT dw.doc_id, dw.m, dw.i, bw.item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, m, i FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_sessions": """
WITH RECURSIVE once AS (
  SELECT * FROM clicks WHERE click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY hash(ts, arrived_at, client_id, kind, value)) = 1),
c AS (SELECT client_id, click_id, epoch_us(ts) AS us, coalesce(epoch_us(arrived_at) - epoch_us(ts) > 900000000, false) AS late, coalesce(value >= 60 AND kind IN ('purchase', 'signup'), false) AS final,
  coalesce(floor(100 * value + 0.5), 0)::BIGINT AS cents FROM once),
hard AS (
  SELECT *, coalesce(was_final OR us - prev >= 900000000, true) AS hard FROM (
    SELECT *, lag(us) OVER w AS prev, lag(final) OVER w AS was_final FROM c WHERE NOT late WINDOW w AS (PARTITION BY client_id ORDER BY us, click_id))),
isl AS (SELECT *, sum(hard::INT) OVER (PARTITION BY client_id ORDER BY us, click_id) AS island FROM hard),
long AS (SELECT client_id, island FROM isl GROUP BY ALL HAVING max(us) - min(us) > 3600000000),
lc AS (SELECT isl.* FROM isl JOIN long USING (client_id, island)),
cuts AS (
  SELECT client_id, island, click_id, us FROM lc WHERE hard
  UNION ALL
  SELECT l.client_id, l.island, l.click_id, l.us FROM cuts s JOIN lc l ON l.client_id = s.client_id AND l.island = s.island AND l.us > s.us + 3600000000 AND l.prev <= s.us + 3600000000 AND NOT l.hard),
marked AS (SELECT i.*, k.click_id IS NOT NULL AS cut FROM isl i LEFT JOIN (SELECT click_id FROM cuts) k ON k.click_id = i.click_id AND NOT i.hard),
numbered AS (SELECT *, sum((hard OR cut)::INT) OVER (PARTITION BY client_id ORDER BY us, click_id) AS s FROM marked),
sess AS (
  SELECT client_id, s, arg_min(click_id, (us, click_id)) AS session_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n_clicks, sum(cents)::BIGINT AS value_cents, arg_max(final, (us, click_id)) AS last_final,
    bool_or(cut) AS cut, sha256(string_agg(click_id::VARCHAR, ',' ORDER BY us, click_id)) AS path_sha256
  FROM numbered GROUP BY client_id, s),
nexts AS (SELECT *, lead(start_us) OVER w AS next_us, lead(cut) OVER w AS next_cut FROM sess WINDOW w AS (PARTITION BY client_id ORDER BY s)),
late AS (SELECT n.client_id, n.s, count(*) AS n_late FROM nexts n JOIN c ON c.client_id = n.client_id AND c.late AND c.us >= n.start_us AND (n.next_us IS NULL OR c.us < n.next_us) GROUP BY ALL)
SELECT client_id, session_id, start_us, end_us, n_clicks, coalesce(n_late, 0) AS n_late, value_cents,
  CASE WHEN last_final THEN 'end' WHEN next_cut IS NULL THEN 'none' WHEN next_cut THEN 'length' ELSE 'gap' END AS closed_by, path_sha256
FROM nexts LEFT JOIN late USING (client_id, s)""",
    # the edits as a graph: minimum costs forward and backward, then the walk along tight arcs
    "op12_repair": r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
keyed AS (
  SELECT *, xor(list_reduce(list_transform(string_split(s, ''), lambda ch: ascii(ch)::BIGINT),
      lambda c, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295::BIGINT), 4294967295) % 20 AS fault FROM raw),
rows AS (
  SELECT conv_id, turn, role AS r0, text AS t0, copy, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed, (VALUES (1), (2)) c(copy) WHERE fault <> 0 AND (copy = 1 OR fault = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r0, t0, copy) AS i FROM rows),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN nth > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS f
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM placed)),
-- an arc for each thing that can be done at row i in state p (0 start, 1 after s, 2 after u, 3 after a)
moves(x, p, q) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
arcs AS (
  SELECT conv_id, i, 'D' AS letter, 2 AS w, p, p AS q FROM judged, range(4) t(p)
  UNION ALL SELECT conv_id, i, 'K', CASE f WHEN 't' THEN 5 ELSE 0 END, p, q FROM judged JOIN moves ON x = left(role, 1) WHERE f IN ('', 't')
  UNION ALL SELECT conv_id, i, 'R', CASE f WHEN 't' THEN 6 ELSE 1 END, p, q FROM judged JOIN moves ON x IN ('u', 'a') WHERE f IN ('', 't')),
ends AS (SELECT conv_id, coalesce(max(i), 0) AS n FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN placed USING (conv_id) GROUP BY conv_id),
ins(p, q, w) AS (VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 5), (1, 2, 5), (3, 2, 5), (2, 3, 5), (0, 3, 10), (1, 3, 10)),
steps AS (SELECT a.conv_id, a.i, a.p, b.q, min(a.w + b.w) AS w FROM arcs a JOIN ins b ON a.q = b.p GROUP BY ALL),
forward AS (
  SELECT conv_id, 0 AS i, q, w AS c FROM ends, ins WHERE p = 0
  UNION ALL
  SELECT conv_id, i, q, min(c) AS c FROM (SELECT f.conv_id, s.i, s.q, f.c + s.w AS c FROM forward f JOIN steps s ON s.conv_id = f.conv_id AND s.i = f.i + 1 AND s.p = f.q) GROUP BY conv_id, i, q),
backsteps AS (SELECT a.conv_id, a.i, b.p, a.q, min(a.w + b.w) AS w FROM arcs a JOIN ins b ON b.q = a.p GROUP BY ALL),
backward AS (
  SELECT conv_id, n AS i, p AS q, min(w) AS c FROM ends, ins WHERE q IN (0, 3) GROUP BY conv_id, n, p
  UNION ALL
  SELECT conv_id, i, q, min(c) AS c FROM (SELECT s.conv_id, s.i - 1 AS i, s.p AS q, b.c + s.w AS c FROM backward b JOIN backsteps s ON s.conv_id = b.conv_id AND s.i = b.i AND s.q = b.q) GROUP BY conv_id, i, q),
best AS (SELECT conv_id, c AS cost FROM backward WHERE i = 0 AND q = 0),
tight AS (
  SELECT a.conv_id, a.i - 1 AS i, a.letter, a.p, a.q, 1 AS went FROM arcs a JOIN forward f ON f.conv_id = a.conv_id AND f.i = a.i - 1 AND f.q = a.p JOIN backward b ON b.conv_id = a.conv_id AND b.i = a.i AND b.q = a.q JOIN best z ON z.conv_id = a.conv_id WHERE f.c + a.w + b.c = z.cost
  UNION
  SELECT f.conv_id, f.i, 'I', f.q, m.q, 0 FROM forward f JOIN moves m ON m.p = f.q AND m.x <> 's' JOIN backward b ON b.conv_id = f.conv_id AND b.i = f.i AND b.q = m.q JOIN best z ON z.conv_id = f.conv_id WHERE f.c + 5 + b.c = z.cost),
-- the frontier as a set of states, the least letter that leaves it
walk AS (
  SELECT conv_id, 0 AS i, [0] AS nodes, '' AS audit, 0 AS last_i, '' AS letter FROM ends
  UNION ALL
  SELECT conv_id, any_value(i) + any_value(went), list_sort(list_distinct(list(q))), any_value(audit) || any_value(letter), any_value(i), any_value(letter) FROM (
    SELECT w.conv_id, w.i, w.audit, t.letter, t.q, t.went, min(t.letter) OVER (PARTITION BY w.conv_id) AS least FROM walk w JOIN tight t ON t.conv_id = w.conv_id AND t.i = w.i AND list_contains(w.nodes, t.p))
  WHERE letter = least GROUP BY conv_id),
audits AS (SELECT conv_id, arg_max(audit, length(audit)) AS audit FROM walk GROUP BY conv_id),
edits AS (SELECT w.conv_id, length(w.audit) AS k, w.last_i + 1 AS i, w.letter, w.nodes[1] AS state FROM walk w WHERE w.audit <> ''),
out AS (
  SELECT e.conv_id, e.k, CASE WHEN e.letter = 'K' THEN j.role WHEN count(*) FILTER (e.letter <> 'D') OVER before % 2 = (CASE WHEN first_s THEN 1 ELSE 0 END) THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e.letter = 'I' THEN '' ELSE j.text END AS line
  FROM edits e LEFT JOIN judged j ON j.conv_id = e.conv_id AND j.i = e.i AND e.letter <> 'I'
  JOIN (SELECT e.conv_id, coalesce(arg_min(e.letter = 'K' AND left(j.role, 1) = 's', e.k) FILTER (e.letter <> 'D'), false) AS first_s FROM edits e LEFT JOIN judged j ON j.conv_id = e.conv_id AND j.i = e.i GROUP BY e.conv_id) s ON s.conv_id = e.conv_id
  WINDOW before AS (PARTITION BY e.conv_id ORDER BY e.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  QUALIFY e.letter <> 'D'),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY k) AS text FROM out GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM judged) GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  z.cost::BIGINT AS cost, a.audit, sha256(coalesce(t.text, '')) AS repaired_sha256
FROM ends e JOIN best z USING (conv_id) JOIN audits a USING (conv_id) LEFT JOIN texts t USING (conv_id) LEFT JOIN counts c USING (conv_id)""",
    "op13_maxscore": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.w, v.w)::BIGINT AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 5""",
}
