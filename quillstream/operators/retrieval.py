"""Ranking: BM25, exact cosine, reciprocal rank fusion, pre-filters, section dedupe.

The question side of every ranking is a bounded question set; the corpus is scanned once and pruned to the
questions' terms before anything is shuffled. Ranks order by rounded score, then by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.text import tokens
from quillstream.functions.vectors import dot, norm
from quillstream.operators import nearest
from quillstream.scratch import fits, small, written


def ranked(scores: DataFrame, k: int, by: tuple[str, ...] = ("qid",), key: str = "doc_id") -> DataFrame:
    """The k best of each question with their rank; WindowGroupLimit keeps k rows a task before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc(key))
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def bm25(docs: DataFrame, questions: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, filters: str | None = None) -> DataFrame:
    """docs (doc_id, text), questions (qid, text) -> qid, doc_id, rank, score. filters: a column both have, equal in a hit.

    The postings of the questions' terms are stored, so that their counts and their scores read no text again.
    """
    keep = [filters] if filters else []
    # the corpus statistics come from all documents, the postings only hold the questions' terms
    terms = questions.select("qid", *[F.col(c).alias(f"q_{c}") for c in keep], F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    toks = docs.select("doc_id", *keep, tokens(F.col("text")).alias("toks"))
    stats = toks.agg(F.count("*").alias("n"), F.avg(F.size("toks")).alias("avgdl"))
    posting = toks.select("doc_id", *keep, F.size("toks").alias("dl"), F.explode("toks").alias("term")).join(small(terms.select("term").distinct()), "term", "left_semi")
    tf = written(posting.groupBy("doc_id", *keep, "dl", "term").agg(F.count("*").alias("tf")))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    weighed = terms.join(df, "term").join(F.broadcast(stats))  # stats is one row
    joined = tf.join(small(weighed), "term")
    if filters:
        joined = joined.where(F.col(filters) == F.col(f"q_{filters}"))
    scores = joined.groupBy("qid", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    return ranked(scores, k).select("qid", "doc_id", "rank", "score")


#: Questions and vectors (expected) that meet in one task: where the best are kept, and where all pairs are (some 20 MB, and 256 MB of pairs at once).
BEST, EVERY = (4096, 32768), (16384, 8192)
#: Fewer vectors than that meet in a task of all pairs, but no fewer than LEAST, as long as there aren't WAVES tasks for each core; and blocks of all pairs are
#: smaller where their vectors have more components together.
LEAST, WAVES, COMPONENTS = 1024, 4, 1 << 23
#: Questions of a block of the vectors that have no cosine with most.
BLOCK = 256


def _plain(vectors: DataFrame, questions: DataFrame, by: str | None) -> DataFrame:
    """The scores of all pairs by column expressions: for vectors of other lengths, or with components that are null or not finite."""
    keep = [by] if by else []
    asked = written(questions.select("qid", *[F.col(c).alias(f"q_{c}") for c in keep], F.col("query").cast("array<double>").alias("query"), norm(F.col("query")).alias("q_norm")))
    rows = vectors.select("vec_id", *keep, F.col("embedding").cast("array<double>").alias("embedding"), norm(F.col("embedding")).alias("norm"))
    n = max(1, -(-asked.count() // BLOCK))
    asked, rows, on = asked.withColumn("qb", _block("qid", n)), rows.withColumn("qb", _each(n)), ["qb"]
    if fits(asked):
        asked = F.broadcast(asked)
    else:
        m = max(1, -(-vectors.count() // (BLOCK * BLOCK)))
        asked, rows, on = asked.withColumn("vb", _each(m)), rows.withColumn("vb", _block("vec_id", m)), ["qb", "vb"]
    pairs = rows.join(asked, on)
    if by:
        pairs = pairs.where(F.col(by) == F.col(f"q_{by}"))
    length = F.col("norm") * F.col("q_norm")
    score = F.when(length == 0, F.lit(0.0)).otherwise(dot(F.col("embedding"), F.col("query")) / length)
    return pairs.select("qid", "vec_id", *keep, F.round(score, 6).alias("score"))


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _each(blocks: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))


def _scored(vectors: DataFrame, questions: DataFrame, by: str | None, k: int | None) -> DataFrame:
    """qid, vec_id, by, score: of all pairs, or with k at least the k best of each question.

    Both sides are dealt over a grid of question and vector blocks, and each pair of blocks meets once in a task (operators.nearest). For all pairs a task
    takes as many questions as a table of 800,000 vectors has, and gives its pairs away by batches: up to there what is shuffled is a few times the input. Vectors that the
    product of blocks can't take (another length than most, a component that is null or not finite) are counted, and meet all others by column expressions.
    """
    keep, (most_q, most_v) = [by] if by else [], EVERY if k is None else BEST
    kind = "array<float>" if {vectors.schema["embedding"].dataType.simpleString(), questions.schema["query"].dataType.simpleString()} == {"array<float>"} else "array<double>"
    # of what array<float> can hold, so that no square overflows
    sound = lambda v: F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) <= 3.5e38)), F.lit(False))
    asked = written(questions.select("qid", *keep, F.col("query").cast(kind).alias("query")))
    rows = vectors.select("vec_id", *keep, F.col("embedding").cast(kind).alias("embedding"))
    sizes = rows.groupBy(sound(F.col("embedding")).alias("sound"), F.size("embedding").alias("size")).agg(F.count("*").alias("n"))
    total, most = sizes.agg(F.sum("n"), F.max(F.when(F.col("sound"), F.struct("n", "size")))).first()
    fit = lambda v: sound(v) & F.coalesce(F.size(v) == F.lit(most["size"] if most else None), F.lit(False))
    asked_fit, rows_fit = fit(F.col("query")), fit(F.col("embedding"))
    n_asked, n_fit = asked.agg(F.count("*"), F.count_if(asked_fit)).first()
    if k is None and most:
        smaller = max(1, -(-(most_q + most_v) * most["size"] // COMPONENTS))
        most_q, most_v = max(1, most_q // smaller), max(1, most_v // smaller)
        most_v = max(min(most_v, LEAST), min(most_v, -(-most["n"] // (WAVES * vectors.sparkSession.sparkContext.defaultParallelism))))
    n, m = max(1, -(-n_fit // most_q)), max(1, -(-(most["n"] if most else 0) // most_v))
    on = [*keep, "qb", "vb"]
    left = rows.where(rows_fit).dropna(subset=keep) if keep else rows.where(rows_fit)
    left = left.withColumn("vb", _block("vec_id", m)).withColumn("qb", _each(n))
    right = asked.where(asked_fit).withColumn("qb", _block("qid", n)).withColumn("vb", _each(m))
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (asked.schema["qid"], rows.schema["vec_id"], *(rows.schema[c] for c in keep)))
    if k is None:
        left = left.withColumnRenamed("embedding", "vector").withColumns({"asks": F.lit(False), "qid": F.lit(None).cast(asked.schema["qid"].dataType)})
        right = right.withColumnRenamed("query", "vector").withColumns({"asks": F.lit(True), "vec_id": F.lit(None).cast(rows.schema["vec_id"].dataType)})
        both = left.unionByName(right).withColumn("block", F.col("qb") * m + F.col("vb")).drop("qb", "vb").repartitionById(n * m, "block")
        found = both.groupBy(*keep, "block").applyInArrow(nearest.paired(tuple(keep)), f"{typed}, score double")
    else:
        found = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(nearest.met(k, tuple(keep)), f"{typed}, score double")
    if total != (most["n"] if most else 0):
        found = found.unionByName(_plain(rows.where(~rows_fit), asked, by))
    if n_asked != n_fit:
        found = found.unionByName(_plain(rows.where(rows_fit), asked.where(~asked_fit), by))
    return found


def scored(vectors: DataFrame, questions: DataFrame, by: str | None = None) -> DataFrame:
    """vectors (vec_id, embedding), questions (qid, query) -> qid, vec_id, score (cosine to 6 places) of all pairs; by: a column of both that has to be equal."""
    return _scored(vectors, questions, by, None)


def vector(vectors: DataFrame, questions: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """The k best vectors of each question: qid, vec_id, rank, score; by is a filter before the top k."""
    found = ranked(_scored(vectors, questions, by, k), k, key="vec_id")
    return found.select("qid", "vec_id", *([by] if by else []), "rank", "score")


def fuse(lists: list[DataFrame], k: int, c: int = 60) -> DataFrame:
    """Reciprocal rank fusion of lists (qid, doc_id, rank): qid, doc_id, rank, score."""
    every = lists[0].select("qid", "doc_id", "rank")
    for one in lists[1:]:
        every = every.unionByName(one.select("qid", "doc_id", "rank"))
    scores = every.groupBy("qid", "doc_id").agg(F.round(F.sum(1.0 / (c + F.col("rank"))), 9).alias("score"))
    return ranked(scores, k).select("qid", "doc_id", "rank", "score")


def search(strategy: str, docs: DataFrame, vectors: DataFrame, questions: DataFrame, query_vectors: DataFrame, k: int) -> DataFrame:
    """bm25, vector or hybrid_rrf; each list is cut at k before fusion."""
    lexical = lambda: bm25(docs, questions, k)
    near = lambda: vector(vectors, query_vectors, k).withColumnRenamed("vec_id", "doc_id")
    found = {"bm25": lexical, "vector": near, "hybrid_rrf": lambda: fuse([lexical(), near()], k)}
    if strategy not in found:
        raise ValueError(f"unknown strategy {strategy}")
    return found[strategy]().withColumn("strategy", F.lit(strategy))


def first_of_section(hits: DataFrame, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Keep the first hit of each (act, section) and rank anew; a null section is the section 'None'."""
    section = F.coalesce(F.col("section"), F.lit("None"))
    seen = Window.partitionBy(*by, "act", section).orderBy("rank")
    kept = hits.withColumn("nth", F.row_number().over(seen)).where("nth = 1").drop("nth")
    return kept.withColumn("section_rank", F.row_number().over(Window.partitionBy(*by).orderBy("rank")).cast("long"))


def projected(hits: DataFrame) -> DataFrame:
    """The hits with the fields of the index only: a vector never leaves it."""
    from quillstream.sources.files import CHUNK_FIELDS

    return hits.select(*[c for c in hits.columns if c in ("qid", "rank", "score", *CHUNK_FIELDS)])


def question_subset(questions: DataFrame, ids: tuple = (), first: int | None = None) -> DataFrame:
    """The questions with the given ids (an unknown one is an error), or the first by id; all without either."""
    if ids:
        wanted = questions.sparkSession.createDataFrame([(i,) for i in ids], questions.select("qid").schema)
        missing = [r["qid"] for r in wanted.join(questions.select("qid"), "qid", "left_anti").collect()]  # of the ids given
        if missing:
            raise ValueError(f"unknown question ids: {sorted(missing)}")
        return questions.join(small(wanted), "qid", "left_semi")
    return questions if first is None else questions.orderBy("qid").limit(first)


def listing(rows: DataFrame, key: str, most: int = 1000) -> DataFrame:
    """Match-all listing of keys: the first `most` by key."""
    return rows.select(key).orderBy(key).limit(most)


def too_many(hits: DataFrame, k: int, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Searches that returned more than k hits: none, or the ranking is wrong."""
    return hits.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > k)


def shortened(hits: DataFrame, chars: int = 500) -> DataFrame:
    """A listing of results to be read: rank, score, label fields and the beginning of the content."""
    return hits.withColumn("content", F.substring("content", 1, chars))
