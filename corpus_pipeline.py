"""The corpus pipeline: five operators over documents, each stage reading what its predecessor kept.

1. language_id: documents without a language (null texts, no letter) go.
2. line_dedup: lines that many documents share stay in one of them; n_chars follows the text.
3. near_dedup: of near copies (shingles of five words, similarity 0.8 or more) the one with the least doc_id stays.
4. decontaminate: documents that share ten words in a row with the benchmark go.
5. mix: how many words of each document the weighted mix takes.

Cases, the same in every stage: null and empty texts go in the first stage; texts that line deduplication empties stay, with no words
to take. Very long texts are read whole. Rows that repeat (doc_id, text) become one in the third stage, the one whose columns have the least
hash; rows of one doc_id with other texts are documents of their own. A null doc_id counts as larger than every other. Ties go to the
smaller doc_id, then to the smaller hash of the text. An empty table gives no rows, an empty benchmark leaves every document.
The first four stages return the columns of documents as they are, whatever further columns are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstream.llm import langid, line_dedup, minhash, mixing, winnowing
from quillstream.llm.common import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows that get a language; labels that differ from the prediction are no reason to go."""
    return langid.keep_identified(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stay in another document."""
    return line_dedup.replace_texts(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies."""
    return minhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that share no window of words with the benchmark."""
    return winnowing.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document: its size, its source's size and target, the words taken."""
    return mixing.mixing_report(docs)


STAGES = [("language_id", language_id), ("line_dedup", drop_lines), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix)]

#: Language ID and the draw of the mix can't be put in SQL; a test replays all stages row by row on a whole table and compares run() with it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
