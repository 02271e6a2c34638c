"""Grounded answers: context, pluggable embedder, generator and judge, citation enforcement."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import citations as C

Embedder = Callable[[list[str]], list[list[float]]]
Generator = Callable[[str, str], str]
Judge = Callable[[str, str, str], dict]

JUDGE_SCHEMA = "answer_relevance int, answer_correctness int, groundedness int, answer_completeness int, citation_correctness int, citation_completeness int, context_utilization int, abstention_quality int, hallucination int, overall_note string, error_tags array<string>"


def context(hits: DataFrame) -> DataFrame:
    """qid, context: the sources in rank order; hits (qid, rank, act, section, content)."""
    block = F.format_string("SOURCE %d\n%s\n%s\n---", F.col("rank").cast("int"), C.label(F.col("act"), F.col("section")), F.col("content"))
    return hits.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n").alias("context"))


def enforce(rows: DataFrame) -> DataFrame:
    """qid, answer, allowed, n_docs -> final answer, citations, insufficient, sources_shown. A citation without a source replaces the answer."""
    cited = C.extracted(F.col("answer"))
    bad = C.unsupported(cited, F.col("allowed"))
    lacking = C.insufficient(F.col("answer"), F.col("n_docs"), F.size(bad))
    return rows.select(
        "qid",
        F.when(F.size(bad) > 0, F.lit(C.REFUSAL)).otherwise(F.col("answer")).alias("final_answer"),
        F.when(lacking, "").otherwise(F.array_join(C.valid(cited, F.col("allowed")), ";")).alias("citations"),
        F.array_join(bad, ";").alias("unsupported"),
        lacking.alias("insufficient"),
        F.when(lacking, 0).otherwise(F.col("n_docs")).cast("long").alias("sources_shown"),
    )


def source_of_label(hits: DataFrame) -> DataFrame:
    """qid, label, doc_id: of several hits with one label the last."""
    return hits.withColumn("label", C.label(F.col("act"), F.col("section"))).groupBy("qid", "label").agg(F.max_by("doc_id", "rank").alias("doc_id"))


def hashing_embedder(dim: int = 64) -> Embedder:
    """An offline embedder: signed word hashing, unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim), np.float32)
        for i, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                out[i, h % dim] += 1.0 if h >> 31 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms > 0, norms, 1)).tolist()

    return embed


def retried(call: Callable, attempts: int = 5, wait: Callable[[float], None] = time.sleep):
    """call() with exponential back-off: 1, 2, 4 ... seconds between attempts."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except Exception:
            if n == attempts:
                raise
            wait(2.0 ** (n - 1))


def embed(rows: DataFrame, embedder: Embedder, model: str, dim: int, batch: int = 32, attempts: int = 5) -> DataFrame:
    """rows (.., content) with embedding_model, embedding_dimensions, embedding; vectors stay in the order of their texts."""
    schema = rows.schema.simpleString()[len("struct<") : -1] + ",embedding_model:string,embedding_dimensions:int,embedding:array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch]
                vectors = retried(lambda: embedder(part["content"].tolist()), attempts)
                if len(vectors) != len(part) or any(len(v) != dim for v in vectors):
                    raise ValueError("the embedder returned the wrong number or size of vectors")
                yield part.assign(embedding_model=model, embedding_dimensions=dim, embedding=vectors)

    return rows.mapInPandas(run, schema)


def extractive(question: str, grounded: str) -> str:
    """An offline generator: the first source's first sentence with its label."""
    lines = grounded.split("\n")
    return f"{lines[2].split('. ')[0]} {lines[1]}" if len(lines) > 2 else "I could not retrieve relevant legal provisions."


def generate(rows: DataFrame, generator: Generator = extractive) -> DataFrame:
    """rows (qid, question, context) -> qid, answer, error; a call that fails leaves its message, not a failed job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for qid, question, grounded in zip(pdf["qid"], pdf["question"], pdf["context"]):
                try:
                    out.append((qid, generator(question, grounded or "") if grounded else "I could not retrieve relevant legal provisions.", None))
                except Exception as error:
                    out.append((qid, None, str(error)))
            yield pd.DataFrame(out, columns=["qid", "answer", "error"])

    return rows.mapInPandas(run, "qid long, answer string, error string")


def is_content_filter(error: Column) -> Column:
    low = F.lower(error)
    return F.coalesce(low.contains("content_filter") | low.contains("content management policy") | low.contains("responsibleaipolicyviolation"), F.lit(False))


def judge(rows: DataFrame, judge_one: Judge) -> DataFrame:
    """rows (qid, question, answer, context) -> qid and the judge's typed scores."""
    import json

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"qid": pdf["qid"], "raw": [json.dumps(judge_one(*x)) for x in zip(pdf["question"], pdf["answer"], pdf["context"])]})

    return rows.mapInPandas(run, "qid long, raw string").select("qid", F.from_json("raw", JUDGE_SCHEMA).alias("judge")).select("qid", "judge.*")


def cards(hits: DataFrame) -> DataFrame:
    """The source cards: the citation id, or the chunk id where it is empty; empty strings become null."""
    return hits.select("qid", "rank", F.coalesce(F.nullif("citation_id", F.lit("")), "chunk_id").alias("source_id"), C.label(F.col("act"), F.col("section")).alias("citation"), F.nullif("section", F.lit("")).alias("section_number"), F.substring("content", 1, 500).alias("content"))


def paragraphs(answers: DataFrame) -> DataFrame:
    """qid, pos, bullet, text: an answer's paragraphs, bullets marked."""
    split = answers.select("qid", F.posexplode(F.split(F.trim("answer"), r"\n\s*\n")).alias("pos", "p"))
    return split.select("qid", "pos", F.col("p").rlike(r"^\s*[-*•]\s+").alias("bullet"), F.regexp_replace("p", r"^\s*[-*•]\s+", "").alias("text"))


# fixed value: the answer where a safety filter has stopped the generator
FILTERED = "The requested legal response could not be generated because the model safety filter blocked this request. No legal conclusion is provided."


def with_fallback(rows: DataFrame) -> DataFrame:
    """Generated rows (qid, answer, error) with status success, content_filtered or error; a filtered one gets the fixed answer, and its sources stay."""
    filtered = is_content_filter(F.col("error"))
    status = F.when(F.col("error").isNull(), "success").when(filtered, "content_filtered").otherwise("error")
    return rows.withColumn("status", status).withColumn("answer", F.when(filtered, F.lit(FILTERED)).otherwise(F.col("answer"))).withColumn("content_filtered", filtered)


def allowed_labels(hits: DataFrame) -> DataFrame:
    """qid, allowed: the sorted labels of the retrieved sources."""
    return hits.groupBy("qid").agg(F.array_sort(F.collect_set(C.label(F.col("act"), F.col("section")))).alias("allowed"))


def linked_citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """qid, pos, citation, doc_id: each label in an answer with the first retrieved source that bears it; null for a label without one."""
    cited = answers.select("qid", F.posexplode(C.extracted(F.col("answer"))).alias("pos", "citation"))
    first = hits.withColumn("citation", C.label(F.col("act"), F.col("section"))).groupBy("qid", "citation").agg(F.min_by("doc_id", "rank").alias("doc_id"))
    return cited.join(first, ["qid", "citation"], "left").select("qid", "pos", "citation", "doc_id")


def judge_payload(hits: DataFrame) -> DataFrame:
    """qid, payload: the sources of a question for the judge, in rank order, as JSON of rank, citation, section_number, section_title and content."""
    item = F.struct("rank", C.label(F.col("act"), F.col("section")).alias("citation"), F.col("section").alias("section_number"), "section_title", "content")
    return hits.groupBy("qid").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("payload"))


def request_columns() -> list[Column]:
    """A request's id and time, for sinks only, as they differ with each run."""
    return [F.expr("uuid()").alias("request_id"), F.current_timestamp().alias("requested_at")]


def answer(hits: DataFrame, questions: DataFrame, generator: Generator = extractive) -> DataFrame:
    """The flow of one question or many: retrieved hits (qid, rank, act, section, content) and questions (qid, text) -> the enforced answers with status."""
    asked = context(hits).join(questions.select("qid", F.col("text").alias("question")), "qid", "right")
    made = with_fallback(generate(asked.select("qid", "question", "context"), generator))
    labelled = made.join(allowed_labels(hits), "qid", "left").join(hits.groupBy("qid").agg(F.count("*").alias("n_docs")), "qid", "left")
    labelled = labelled.withColumn("allowed", F.coalesce("allowed", F.array().cast("array<string>"))).withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
    return enforce(labelled).join(made.select("qid", "status", "content_filtered"), "qid")


def replay(questions: DataFrame, done: DataFrame, ask: Callable[[str, str], str], attempts: int = 3) -> DataFrame:
    """Send every question (qid, text, act) that has no result yet to a service: qid, answer, error; a call that fails for good leaves its message."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for qid, text, act in zip(pdf["qid"], pdf["text"], pdf["act"]):
                try:
                    out.append((qid, retried(lambda: ask(text, act), attempts), None))  # noqa: B023
                except Exception as error:
                    out.append((qid, None, str(error)))
            yield pd.DataFrame(out, columns=["qid", "answer", "error"])

    left = questions.join(done.select("qid").distinct(), "qid", "left_anti")
    return left.select("qid", "text", "act").mapInPandas(run, "qid long, answer string, error string")
