"""Exact top-k by integer inner product: MaxScore over shards of postings.

A document is a list of terms with integer weights (a vector: its positions and components), negative ones included. Documents are
dealt to shards of about SHARD rows, queries to blocks of about BLOCK rows, and every block meets every shard once. A shard's
postings hold, for each term, the documents that have it and the least and largest weight. For one query a term adds between `low`
and `up` to a document's score; terms are taken by falling up - low, the essential ones first. After each, a document's score lies
between what it is sure of and that plus the spread of the terms still to come, and the k-th best of the sure scores is the
threshold. Once the spread of the remaining, non-essential terms can't lift every document over it, only those that still compete
are probed for them, and each probe drops more. Documents of equal bounds stay in, so ties are whole. The best k of each shard are merged.

Cases: vectors that are null or hold null or non-finite components take no part; empty ones score 0 with every other; a term that a
document lacks adds 0. Rows that repeat one id count once, the one whose vector has the least hash. Ties go to the smaller id. Fewer than k
candidates: all of them. Weights and scores are 64-bit: components beyond about 2^22 in size may overflow. An empty table gives no rows;
further columns are ignored. A task holds SHARD documents and BLOCK queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.common import written

SHARD, BLOCK = 2048, 1024
TOP = 5
#: Terms taken before the threshold is found anew.
STEP = 4

_HITS = "query_id long, vec_id long, score long"


class Postings:
    """A shard: ids, and for each term the places of its documents in ids with their weights."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        self.ids = ids
        rows = np.repeat(np.arange(len(ids)), lengths)
        order = np.lexsort((rows, terms))
        terms, self.rows, self.weights = terms[order], rows[order], weights[order]
        self.terms, self.start = np.unique(terms, return_index=True)
        self.end = np.append(self.start[1:], len(terms))
        self.least = np.minimum.reduceat(self.weights, self.start) if len(terms) else np.zeros(0, np.int64)
        self.most = np.maximum.reduceat(self.weights, self.start) if len(terms) else np.zeros(0, np.int64)
        lacking = self.end - self.start < len(ids)  # a document without the term gets 0 from it
        self.least[lacking] = np.minimum(self.least[lacking], 0)
        self.most[lacking] = np.maximum(self.most[lacking], 0)

    def added(self, t: int, live: np.ndarray | None) -> np.ndarray:
        """The weights of term t in all documents, or in the places `live`."""
        a, b = self.start[t], self.end[t]
        if b - a == len(self.ids):
            return self.weights[a:b] if live is None else self.weights[a:b][live]
        out = np.zeros(len(self.ids) if live is None else len(live), np.int64)
        if live is None:
            out[self.rows[a:b]] = self.weights[a:b]
        else:
            at = np.searchsorted(self.rows[a:b], live)
            hit = at < b - a
            hit[hit] = self.rows[a:b][at[hit]] == live[hit]
            out[hit] = self.weights[a:b][at[hit]]
        return out

    def best(self, own: int, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of at least the k best documents other than `own` (fewer if there aren't as many)."""
        at = np.searchsorted(self.terms, terms)
        known = at < len(self.terms)
        known[known] = self.terms[at[known]] == terms[known]
        at, weights = at[known], weights[known]
        ends = np.stack([self.least[at] * weights, self.most[at] * weights])
        low, spread = ends.min(axis=0), ends.max(axis=0) - ends.min(axis=0)
        order = np.argsort(-spread, kind="stable")
        rest = int(spread.sum())
        live: np.ndarray | None = None
        sure = np.full(len(self.ids), int(low.sum()), np.int64)
        mine = np.flatnonzero(self.ids == own)
        if len(mine):
            live = np.delete(np.arange(len(self.ids)), mine)
            sure = sure[live]
        for n, i in enumerate(order, 1):
            sure = sure + (self.added(at[i], live) * weights[i] - low[i])
            rest -= int(spread[i])
            if n % STEP == 0 and len(sure) > k:
                threshold = np.partition(sure, len(sure) - k)[len(sure) - k]
                keep = sure + rest >= threshold
                # while most documents compete, the postings are traversed whole; then only the competing ones are probed
                if 2 * np.count_nonzero(keep) <= len(keep):
                    live, sure = np.flatnonzero(keep) if live is None else live[keep], sure[keep]
        places = np.arange(len(self.ids)) if live is None else live
        if len(places) > k:
            keep = sure >= np.partition(sure, len(sure) - k)[len(sure) - k]
            places, sure = places[keep], sure[keep]
            first = np.lexsort((self.ids[places], -sure))[:k]
            places, sure = places[first], sure[first]
        return places, sure


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The lengths and the values of a column of lists."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.value_lengths().fill_null(0), np.int64), np.asarray(flat.flatten(), np.int64)


def _search(k: int):
    def search(docs: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if docs.num_rows and asked.num_rows:
            lengths, terms = _lists(docs["terms"])
            shard = Postings(np.asarray(docs["vec_id"], np.int64), lengths, terms, _lists(docs["weights"])[1])
            lengths, terms = _lists(asked["terms"])
            weights, end = _lists(asked["weights"])[1], np.cumsum(lengths)
            for qid, a, b in zip(asked["query_id"].to_pylist(), end - lengths, end):
                places, scores = shard.best(qid, terms[a:b], weights[a:b], k)
                for column, part in zip(out, (np.full(len(places), qid, np.int64), shard.ids[places], scores)):
                    column.append(part)
        return pa.table({n: np.concatenate(x) if x else np.zeros(0, np.int64) for n, x in zip(("query_id", "vec_id", "score"), out)})

    return search


def vector_terms(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, embedding -> vec_id, terms (places), weights (floor(scale * component)) of the vectors that take part."""
    x: Column = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select("vec_id", x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & sound)
    weights = F.transform("x", lambda v: F.floor(v * float(scale)).cast("long"))
    terms = F.when(F.size("x") == 0, F.array().cast("array<long>")).otherwise(F.sequence(F.lit(0).cast("long"), F.size("x").cast("long") - 1))
    return rows.groupBy("vec_id").agg(F.min_by("x", F.xxhash64("x")).alias("x")).select("vec_id", terms.alias("terms"), weights.alias("weights"))


def search(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """docs (vec_id, terms, weights), queries (query_id, terms, weights), one row for each id -> query_id, rank, vec_id, score.

    A query doesn't find the document that has its own id.
    """
    docs, queries = written(docs.select("vec_id", "terms", "weights")), written(queries.select("query_id", "terms", "weights"))
    shards, blocks = max(1, -(-docs.count() // SHARD)), max(1, -(-queries.count() // BLOCK))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = docs.withColumn("shard", part("vec_id", shards)).withColumn("block", each(blocks))
    asked = queries.withColumn("block", part("query_id", blocks)).withColumn("shard", each(shards))
    hits = dealt.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(_search(k), _HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_report(vectors: DataFrame, k: int = TOP, every: int = 50) -> DataFrame:
    """Every vector whose id is divisible by `every` against all others."""
    docs = written(vector_terms(vectors))
    return search(docs, docs.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id"), k)
