"""Retrieval and answer metrics over ranked hits and graded gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.vectors import cosine
from quillstream.scratch import written


def gold_grades(gold: DataFrame, key: str) -> DataFrame:
    """qid, key, grade: the largest grade of each key."""
    return gold.groupBy("qid", key).agg(F.max("grade").cast("long").alias("grade"))


def retrieval_metrics(hits: DataFrame, gold: DataFrame, ks: tuple[int, ...], key: str = "doc_id", by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """hits (by.., key, rank), gold (qid, key, grade) -> by.., final_k and recall, precision, hit, mrr, ndcg.

    Precision divides by what was retrieved; the ideal list is cut to that length; recall is at most 1. Questions
    without gold score 0. Questions come from the hits.
    """
    grades = written(gold_grades(gold, key))
    grid = F.explode(F.array(*[F.lit(k) for k in ks])).alias("final_k")
    graded = hits.join(grades, ["qid", key], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    cut = graded.select(*by, "rank", "grade", grid).where("rank <= final_k")
    gain = lambda g, r: (F.pow(F.lit(2.0), F.col(g)) - 1) / F.log2(F.col(r) + 1)
    got = cut.groupBy(*by, "final_k").agg(
        F.count("*").alias("n"), F.sum((F.col("grade") > 0).cast("long")).alias("relevant"), F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"), F.sum(gain("grade", "rank")).alias("dcg")
    )
    got = written(got)  # a few rows for each question
    ideal = grades.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), key)))
    sizes = grades.groupBy("qid").agg(F.count("*").alias("n_gold"))
    best = got.select("qid", "n").distinct().join(ideal, "qid").where("place <= n").groupBy("qid", "n").agg(F.sum(gain("grade", "place")).alias("idcg"))
    joined = got.join(sizes, "qid", "left").join(best, ["qid", "n"], "left")
    zero = F.lit(0.0)
    return joined.select(
        *by,
        F.col("final_k").cast("long").alias("final_k"),
        F.round(F.when(F.col("n_gold").isNull(), zero).otherwise(F.least(F.col("relevant") / F.col("n_gold"), F.lit(1.0))), 6).alias("recall"),
        F.round(F.col("relevant") / F.col("n"), 6).alias("precision"),
        F.when(F.col("relevant") > 0, 1.0).otherwise(0.0).alias("hit"),
        F.round(F.coalesce(1.0 / F.col("first"), zero), 6).alias("mrr"),
        F.round(F.coalesce(F.col("dcg") / F.col("idcg"), zero), 6).alias("ndcg"),
    )


def pairwise_cosine(hits: DataFrame, vectors: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """qid, final_k, avg_cosine over the pairs i < j of the first k hits that have a vector; null below two."""
    # the hits and their vectors are stored: the search isn't run again for each side of the pairs
    rows = written(hits.where(F.col("rank") <= max(ks)).join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").select("qid", "rank", "embedding"))
    upto = lambda rank: F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col(rank))).alias("final_k")
    later = rows.select("qid", F.col("rank").alias("later"), F.col("embedding").alias("other"))
    pairs = rows.join(later, "qid").where("rank < later").select("qid", "later", cosine(F.col("embedding"), F.col("other")).alias("cosine"))  # at most max(ks)**2 of a question
    means = pairs.select("qid", "cosine", upto("later")).groupBy("qid", "final_k").agg(F.round(F.avg("cosine"), 6).alias("avg_cosine"))
    return rows.select("qid", upto("rank")).distinct().join(means, ["qid", "final_k"], "left").select("qid", F.col("final_k").cast("long").alias("final_k"), "avg_cosine")


def section_spread(hits: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """qid, final_k, unique_ratio, redundancy: distinct (act, section) among the first k."""
    grid = F.explode(F.array(*[F.lit(k) for k in ks])).alias("final_k")
    key = F.struct("act", F.coalesce("section", F.lit("None")))
    got = hits.select("qid", "rank", key.alias("key"), grid).where("rank <= final_k").groupBy("qid", "final_k").agg(F.countDistinct("key").alias("u"), F.count("*").alias("n"))
    return got.select("qid", F.col("final_k").cast("long").alias("final_k"), F.round(F.col("u") / F.col("n"), 6).alias("unique_ratio"), F.round(1 - F.col("u") / F.col("n"), 6).alias("redundancy"))


MEANS = ("recall", "precision", "hit", "mrr", "ndcg")


def mean_of_millionths(m: str) -> Column:
    """The mean of values of 6 places, to 6 places, half up: counted in whole millionths, so that no order of additions shows."""
    total, n = F.sum(F.round(F.col(m) * 1e6).cast("long")), F.count(m)
    return F.floor((2 * total + n).cast("decimal(20,0)") / (2 * n)).cast("double") / 1e6


def summary(rows: DataFrame, by: tuple[str, ...] = ("strategy", "candidate_k", "final_k", "level")) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("question_count"), *[mean_of_millionths(m).alias(m) for m in MEANS])


def judge_summary(rows: DataFrame, metrics: tuple[str, ...], top: int) -> DataFrame:
    """metric, mean (4 places), pct = 100 * sum / (top * n) (2 places), zeros; null scores don't count."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select("x.*").where("v is not null")
    return long.groupBy("metric").agg(F.bround(F.avg("v"), 4).alias("mean"), F.bround(100.0 * F.sum("v") / (top * F.count("*")), 2).alias("pct"), F.count("*").alias("n"), F.count_if(F.col("v") == 0).alias("zeros"))


def deterministic(rows: DataFrame) -> DataFrame:
    """Columns answer, allowed (labels), retrieved, gold, direct (section arrays) -> the deterministic answer metrics."""
    from quillstream.functions.citations import extracted, has_text, unsupported

    share = lambda want: F.when(F.size(want) == 0, F.lit(1.0)).otherwise(F.bround(F.size(F.array_intersect(F.array_distinct(F.col("retrieved")), want)) / F.size(want), 4))
    cited, gold, direct = extracted(F.col("answer")), F.array_distinct("gold"), F.array_distinct("direct")
    bad = unsupported(cited, F.col("allowed"))
    return rows.select(
        "qid",
        share(gold).alias("gold_section_coverage"),
        share(direct).alias("direct_gold_coverage"),
        (F.size(F.array_except(direct, F.col("retrieved"))) == 0).alias("all_direct_gold_retrieved"),
        F.array_join(cited, ";").alias("citations"),
        F.array_join(bad, ";").alias("unsupported_citations"),
        (F.size(bad) == 0).alias("citation_syntax_valid"),
        (F.size(bad) == 0).alias("all_citations_from_retrieved_sources"),
        F.size(cited).cast("long").alias("citation_count"),
        has_text(F.col("answer")).alias("has_substantive_answer_text"),
        (has_text(F.col("answer")) & (F.size(cited) > 0)).alias("has_citation_with_answer"),
    )


RUBRIC = ("answer_relevance", "answer_correctness", "groundedness", "answer_completeness", "citation_correctness", "citation_completeness", "context_utilization", "abstention_quality", "hallucination")


def answer_flags(rows: DataFrame) -> DataFrame:
    """One row of counts over evaluated answers: columns status, all_direct_gold_retrieved, n_unsupported, judge_status and the rubric."""
    judged = F.col("judge_status") == "success"
    return rows.agg(
        F.count("*").alias("n"), F.count_if(~F.col("all_direct_gold_retrieved")).alias("direct_gold_not_fully_retrieved"), F.count_if((F.col("status") == "success") & (F.col("n_unsupported") > 0)).alias("unsupported_citations"),
        F.count_if(judged & (F.col("hallucination") == 2)).alias("material_hallucination"), F.count_if(judged & (F.col("answer_correctness") == 0)).alias("correctness_zero"), F.count_if(judged & (F.col("groundedness") == 0)).alias("groundedness_zero"),
        F.count_if(F.col("status") == "content_filtered").alias("generation_content_filtered"), F.count_if(F.col("status") == "success").alias("generation_successful"),
        F.count_if(F.col("judge_status") == "content_filtered").alias("judge_content_filtered"), F.count_if(judged).alias("judge_successful"),
    )


def split_means(rows: DataFrame, condition: str = "all_direct_gold_retrieved", metrics: tuple[str, ...] = ("answer_correctness", "groundedness")) -> DataFrame:
    """metric, group, mean (4 places), n: the means of judged answers where retrieval was sufficient and where it wasn't; groups without answers have no row."""
    long = rows.where("judge_status = 'success'").select(F.when(F.col(condition), "sufficient").otherwise("insufficient").alias("group"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x"))
    return long.where("x.v is not null").groupBy(F.col("x.metric").alias("metric"), "group").agg(F.bround(F.avg("x.v"), 4).alias("mean"), F.count("*").alias("n"))
