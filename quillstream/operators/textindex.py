"""A stored inverted index over texts: created once, updated by segments, searched for the best k by BM25 with block bounds.

Documents are dealt by the hash of their id to segments of about SEGMENT_DOCS rows, and a segment's terms to BUCKETS ranges of their
hash (fewer in smaller segments, so that files don't shrink with them). Under the index's folder, postings/version=V/segment=S/bucket=B holds one file sorted by term, a row for each block of at most
BLOCK documents of a term: docs, tfs and dls in order of id, with n, the first and last id, the largest tf and the least dl. As
a share of BM25 grows with tf and falls with dl, these two bound what the block can give, whatever the mean length is. documents/version=V/segment=S
holds the length and the filter columns of each document. manifest.json names the version that each segment has; it is replaced
by one rename, so a reader sees an index before or after an update, never between. An update rewrites the segments of the changed ids
from their own postings and the new texts, and no other file.

Texts are split into words by Spark; words are counted by slices of documents, and a segment's postings are sorted and cut into blocks as whole arrays.

A search reads the blocks of its terms, by the buckets' folders and a join with the terms, and meets each block of questions with each
segment once, small segments several in a task. In a segment a question's terms are taken by falling bound. The k-th best of the scores so far is a threshold; once the bounds of the
remaining, common terms add up to less, no other document can come in, and these terms are only looked up for the
documents that still compete, in blocks whose bound can lift them over it. The best k of the segments are merged. The result is that of scoring
everything: bounds only leave out what is below the threshold by more than the rounding of scores. A task holds the postings of its terms in one segment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.functions.text import tokens, words
from quillstream.operators.versioned import Versioned
from quillstream.scratch import small, written

#: Documents of a segment (expected), ranges of its terms, documents of a block at most.
SEGMENT_DOCS, BUCKETS, BLOCK = 1 << 13, 16, 128
#: Documents whose words are counted together.
SLICE = 1 << 10
#: Questions that meet a segment together.
QUESTIONS = 1024
#: Scores are rounded to six places; bounds have to fail by more than that.
SLACK = 2e-6

_HITS = "qid long, doc_id long, score double"


_BLOCKS = "segment int, term string, block int, n int, lo long, hi long, max_tf int, min_dl int, docs array<long>, tfs array<int>, dls array<int>"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with words (the text's, one space between them) -> dl, terms and tfs in their place."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            lists = pa.compute.split_pattern(part["words"], " ")
            flat = lists.flatten().dictionary_encode()
            codes = np.asarray(flat.indices, np.int64)
            rows = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths(), np.int64))
            if (empty := flat.dictionary.index("").as_py()) >= 0:  # a text without words splits into one empty string
                rows, codes = rows[codes != empty], codes[codes != empty]
            most = max(1, len(flat.dictionary))
            keys, tfs = np.unique(rows * most + codes, return_counts=True)
            ends = pa.array(np.searchsorted(keys, np.arange(part.num_rows + 1) * most), pa.int32())
            made = {
                "dl": pa.array(np.bincount(rows, minlength=part.num_rows), pa.int32()),
                "terms": pa.ListArray.from_arrays(ends, flat.dictionary.take(pa.array(keys % most))),
                "tfs": pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32())),
            }
            kept = [n for n in part.schema.names if n != "words"]
            yield pa.RecordBatch.from_arrays([*(part[n] for n in kept), *made.values()], [*kept, *made])


def _lists(table: pa.Table, name: str) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists one after the other, and each row's number of them."""
    column = table[name].combine_chunks()
    return column.flatten(), np.asarray(column.value_lengths().fill_null(0), np.int64)


def _cut(changed: pa.Table, old: pa.Table | None = None) -> pa.Table:
    """A segment's documents (segment, doc_id, dl, terms, tfs; without terms where they go) and its old blocks -> its blocks."""
    names, n = _lists(changed, "terms")
    docs, dls, tfs = np.repeat(np.asarray(changed["doc_id"], np.int64), n), np.repeat(np.asarray(changed["dl"].fill_null(0), np.int32), n), np.asarray(_lists(changed, "tfs")[0], np.int32)
    if old is not None and old.num_rows:
        before, n = _lists(old, "docs")
        held = pa.concat_arrays([names, old["term"].combine_chunks()]).dictionary_encode()
        codes = np.asarray(held.indices, np.int64)
        codes = np.concatenate((codes[: len(names)], np.repeat(codes[len(names) :], n)))
        stays = np.concatenate((np.ones(len(docs), bool), ~np.isin(np.asarray(before, np.int64), np.asarray(changed["doc_id"], np.int64))))
        both = lambda new, name: np.concatenate((new, np.asarray(_lists(old, name)[0], new.dtype)))[stays]
        codes, docs, tfs, dls = codes[stays], both(docs, "docs"), both(tfs, "tfs"), both(dls, "dls")
    else:
        held = names.dictionary_encode()
        codes = np.asarray(held.indices, np.int64)
    ids, places = np.unique(docs, return_inverse=True)
    order = np.argsort(codes * max(1, len(ids)) + places, kind="stable")
    codes, docs, tfs, dls = codes[order], docs[order], tfs[order], dls[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))  # of each term
    nth = np.arange(len(codes)) - np.repeat(first, np.diff(first, append=len(codes)))
    starts = np.flatnonzero(nth % BLOCK == 0)
    ends = np.append(starts, len(codes))
    offsets = pa.array(ends, pa.int32())
    listed = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x))
    best = lambda f, x: f.reduceat(x, starts) if len(starts) else x
    segment = (changed if changed.num_rows else old)["segment"][0].as_py()
    made = {
        "segment": np.full(len(starts), segment, np.int32), "term": held.dictionary.take(pa.array(codes[starts])), "block": (nth[starts] // BLOCK).astype(np.int32), "n": np.diff(ends).astype(np.int32), "lo": docs[starts], "hi": docs[ends[1:] - 1],
        "max_tf": best(np.maximum, tfs), "min_dl": best(np.minimum, dls), "docs": listed(docs), "tfs": listed(tfs), "dls": listed(dls),
    }
    return pa.table(made)


class TextIndex(Versioned):
    """An index in a folder that driver and executors share."""

    TABLES = ("postings", "documents")

    @classmethod
    def create(cls, spark: SparkSession, path: str, docs: DataFrame, filters: tuple[str, ...] = (), segment_docs: int = SEGMENT_DOCS) -> "TextIndex":
        """docs (doc_id long, text, filters..), one row for each id. Rows without an id are left out; a null text has no terms but counts as a document."""
        if taken := {"doc_id", "dl", "terms", "tfs", "segment", "version", "words"} & set(filters):
            raise ValueError(f"names that the index needs itself: {sorted(taken)}")
        segments = max(1, -(-docs.count() // segment_docs))
        # as many files for a number of documents, whatever the segments' size; together: segments that a task of a search takes
        buckets, together = max(1, min(BUCKETS, BUCKETS * segment_docs // SEGMENT_DOCS)), max(1, SEGMENT_DOCS // segment_docs)
        made = cls.new(spark, path, segments, filters=list(filters), buckets=buckets, together=together)
        made._publish(made._counted(docs))
        return made

    @classmethod
    def create_or_update(cls, spark: SparkSession, path: str, docs: DataFrame, filters: tuple[str, ...] = ()) -> "TextIndex":
        if not cls.exists(spark, path):
            return cls.create(spark, path, docs, filters)
        found = cls.open(spark, path)
        if found.manifest["filters"] != list(filters):
            raise ValueError(f"the index at {path} has the filters {found.manifest['filters']}")
        found.update(docs)
        return found

    def _counted(self, docs: DataFrame) -> DataFrame:
        """segment, doc_id, filters.., dl, terms, tfs: stored, so that texts are read once."""
        rows = docs.where("doc_id is not null").select(self.segment("doc_id").alias("segment"), F.col("doc_id").cast("long"), *self.manifest["filters"], words(F.col("text")).alias("words"))
        kinds = T.StructType(rows.drop("words").schema.fields).add("dl", T.IntegerType()).add("terms", T.ArrayType(T.StringType())).add("tfs", T.ArrayType(T.IntegerType()))
        return written(rows.mapInArrow(_count, kinds))

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.manifest.get("buckets", BUCKETS))).cast("int")

    def _publish(self, counted: DataFrame, touched: list[int] | None = None, gone: DataFrame | None = None) -> None:
        """The blocks of counted documents, in touched segments with what these hold but for the ids of counted and gone (segment, doc_id)."""
        postings, documents = counted.select("segment", "doc_id", "dl", "terms", "tfs"), counted.drop("terms", "tfs")
        if touched is None:
            made = postings.groupBy("segment").applyInArrow(lambda new: _cut(new), _BLOCKS)
        else:
            if gone is not None:
                postings = postings.unionByName(gone, allowMissingColumns=True)
            old = self.blocks(touched).select("segment", "term", "docs", "tfs", "dls")
            made = postings.groupBy("segment").cogroup(old.groupBy("segment")).applyInArrow(lambda new, had: _cut(new, had), _BLOCKS)
            kept = self.documents(touched).drop("version").join(postings.select("doc_id"), "doc_id", "left_anti")
            documents = documents.unionByName(kept)
        blocks = made.withColumn("bucket", self._bucket(F.col("term"))).sortWithinPartitions("segment", "bucket", "term", "block")
        self.publish({"postings": blocks, "documents": documents.repartition("segment")}, touched, by=("bucket",))

    def blocks(self, segments: list[int] | None = None) -> DataFrame:
        return self.table("postings", "term string, block int, n int, lo long, hi long, max_tf int, min_dl int, docs array<long>, tfs array<int>, dls array<int>, version int, segment int, bucket int", segments)

    def documents(self, segments: list[int] | None = None) -> DataFrame:
        filters = "".join(f"`{f}` string, " for f in self.manifest["filters"])
        return self.table("documents", f"doc_id long, {filters}dl int, version int, segment int", segments)

    def update(self, changed: DataFrame, deleted: DataFrame | None = None) -> list[int]:
        """Put documents in the place of those with their ids, take the deleted ids out; the segments that were rewritten."""
        counted, gone = self._counted(changed), None
        ids = counted.select("segment")
        if deleted is not None:
            gone = written(deleted.where("doc_id is not null").select(self.segment("doc_id").alias("segment"), F.col("doc_id").cast("long")))
            ids = ids.unionByName(gone.select("segment"))
        touched = sorted(r["segment"] for r in ids.distinct().collect())  # at most one row a segment
        if touched:
            self._publish(counted, touched, gone)
        return touched

    def bm25(self, questions: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, equal: str | None = None) -> DataFrame:
        """questions (qid long, text[, equal]) -> qid, doc_id, rank, score: the k best, ties to the smaller id. equal: a filter column that a hit shares with its question.

        Equal to retrieval.bm25 over the same documents.
        """
        if equal is not None and equal not in self.manifest["filters"]:
            raise ValueError(f"the index has no filter {equal}")
        wanted = F.col(equal).cast("string") if equal else F.lit(None).cast("string")
        asked = questions.select("qid", wanted.alias("wanted"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
        asked = written(asked.withColumn("bucket", self._bucket(F.col("term"))))
        buckets = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # BUCKETS at most
        sought = small(asked.select("bucket", "term").distinct())
        mine = self.blocks().where(F.col("bucket").isin(buckets)).join(sought, ["bucket", "term"], "left_semi")
        df = mine.groupBy("term").agg(F.sum("n").alias("df"))  # reads no arrays
        total = self.documents().agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl")).first()
        weighed = asked.join(df, "term").select("qid", "wanted", "term", F.log(1 + (total["docs"] - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        weighed = written(weighed)
        blocks = max(1, -(-weighed.select("qid").distinct().count() // QUESTIONS))
        each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        postings = mine.select("segment", "term", "block", "max_tf", "min_dl", "docs", "tfs", "dls", F.lit(None).cast("string").alias("has"))
        if equal:
            allowed = self.documents().groupBy("segment", F.col(equal).cast("string").alias("has")).agg(F.sort_array(F.collect_list("doc_id")).alias("docs"))  # bounded by the segment
            postings = postings.unionByName(allowed, allowMissingColumns=True)
        together = self.manifest.get("together", 1)
        tasks = F.explode(F.sequence(F.lit(0), F.lit((self.manifest["segments"] - 1) // together)))
        dealt = weighed.withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).withColumn("task", tasks)
        postings = postings.withColumn("part", each).withColumn("task", F.expr(f"segment div {together}").cast("int"))
        hits = postings.groupBy("task", "part").cogroup(dealt.groupBy("task", "part")).applyInArrow(_search(k, k1, b, total["avgdl"] or 1.0, equal is not None), _HITS)
        order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("doc_id"))
        scores = hits.withColumn("score", F.round("score", 6))
        return scores.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("qid", "doc_id", "rank", "score")


class _Segment:
    """The postings of a segment's terms in arrays: places in ids, what each adds but for the term's idf, and the bounds of blocks and terms."""

    def __init__(self, table: pa.Table, k1: float, b: float, avgdl: float) -> None:
        table = table.sort_by([("term", "ascending"), ("block", "ascending")]).combine_chunks()
        flat = lambda name, kind: np.asarray(table[name].combine_chunks().flatten(), kind)
        share = lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
        docs = flat("docs", np.int64)
        self.ids, self.places = np.unique(docs, return_inverse=True)
        self.adds = share(flat("tfs", float), flat("dls", float))
        self.bound = share(np.asarray(table["max_tf"], float), np.asarray(table["min_dl"], float))  # of each block
        ends = np.cumsum(np.asarray(table["docs"].combine_chunks().value_lengths(), np.int64))
        names = table["term"].to_pylist()
        first = [i for i, t in enumerate(names) if i == 0 or t != names[i - 1]]
        starts = np.concatenate(([0], ends))
        #: term -> its blocks and its postings, as ranges
        self.terms = {names[i]: (i, j, int(starts[i]), int(starts[j])) for i, j in zip(first, [*first[1:], len(names)])}
        self.block_start = starts

    def best(self, asked: list[tuple[str, float]], k: int, allowed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best by the rounded score for (term, idf), among the places that are allowed."""
        found = [(idf * self.bound[r[0] : r[1]].max(), t, idf, r) for t, idf in asked if (r := self.terms.get(t)) is not None]
        found.sort(key=lambda x: (-x[0], x[1]))
        rest, least = sum(x[0] for x in found), 0.0
        scores = np.zeros(len(self.ids))
        n = 0
        while n < len(found) and rest >= least - SLACK:
            bound, _, idf, (_, _, a, z) = found[n]
            scores[self.places[a:z]] += idf * self.adds[a:z]
            rest, n = rest - bound, n + 1
            top = scores if allowed is None else scores[allowed]
            if len(top) >= k and rest < top.max(initial=0.0):
                least = max(least, float(np.partition(top, len(top) - k)[len(top) - k]))
        here = np.flatnonzero((scores > 0) & (scores + rest >= least - SLACK)) if allowed is None else allowed[(scores[allowed] > 0) & (scores[allowed] + rest >= least - SLACK)]
        sums = scores[here]
        for bound, _, idf, (i, j, a, z) in found[n:]:
            # a competing document's block: the last one that begins at its place or before
            block = i + np.searchsorted(self.places[self.block_start[i:j]], here, "right") - 1
            may = (block >= i) & (sums + (rest - bound) + idf * self.bound[np.maximum(block, i)] >= least - SLACK)
            at = a + np.searchsorted(self.places[a:z], here)
            hit = may & (at < z)
            hit[hit] = self.places[at[hit]] == here[hit]
            sums[hit] += idf * self.adds[at[hit]]
            rest -= bound
            if len(sums) >= k:
                least = max(least, float(np.partition(sums, len(sums) - k)[len(sums) - k]))
            keep = sums + rest >= least - SLACK
            here, sums = here[keep], sums[keep]
        order = np.lexsort((self.ids[here], -np.floor(sums * 1e6 + 0.5)))[:k]
        return self.ids[here[order]], sums[order]


def _search(k: int, k1: float, b: float, avgdl: float, filtered: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def search(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        questions: dict[int, tuple[str | None, list[tuple[str, float]]]] = {}
        for qid, wanted, term, idf in zip(*(asked[c].to_pylist() for c in ("qid", "wanted", "term", "idf"))):
            questions.setdefault(qid, (wanted, []))[1].append((term, idf))
        for one in pa.compute.unique(blocks["segment"]).to_pylist() if questions else []:
            held = blocks.filter(pa.compute.equal(blocks["segment"], one))
            postings = held.filter(pa.compute.is_valid(held["term"]))
            if not postings.num_rows:
                continue
            segment = _Segment(postings, k1, b, avgdl)
            allowed: dict[str, np.ndarray] = {}
            if filtered:
                for row in held.filter(pa.compute.and_(pa.compute.is_null(held["term"]), pa.compute.is_valid(held["has"]))).select(["has", "docs"]).to_pylist():
                    allowed[row["has"]] = np.flatnonzero(np.isin(segment.ids, np.array(row["docs"], np.int64)))
            for qid, (wanted, terms) in questions.items():
                ids, scores = segment.best(terms, k, allowed.get(wanted, np.zeros(0, np.int64)) if filtered else None)
                for column, part in zip(out, (np.full(len(ids), qid, np.int64), ids, scores)):
                    column.append(part)
        kinds = (np.int64, np.int64, float)
        return pa.table({n: np.concatenate(x) if x else np.zeros(0, t) for n, x, t in zip(("qid", "doc_id", "score"), out, kinds)})

    return search
