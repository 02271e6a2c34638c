"""Line deduplication: hashes range-partitioned with a secondary sort by document and position, streamed once.

Every line that can repeat becomes a row (128-bit hash of its key, document, position). The rows are partitioned by
range over (hash, document, position), so that one hash shared by a third of all documents is spread over many
partitions, and sorted inside them with the largest document first. A run of equal hashes may cross partitions;
one row for each partition says how its first and last run go on, and with it each partition is streamed alone: the
first document of a run keeps the line, later ones drop it once the run is known to hold enough documents. The
result is a compressed bitmap for each document that loses lines, not its text.

Cases: a null or empty text is one empty line. A null doc_id is one document, smaller than every other. Repeated rows
(same doc_id and text) are one document and get the same bitmap; rows of one doc_id with other texts count as one
document but are cut separately. Documents of which nothing is dropped have no bitmap. Very long texts are rows of lines. Ties of doc_id are one
document. An empty table gives no rows. Other columns are carried along in a struct, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.llm.common import checkpointed, quoted, shuffle_partitions, small, text_pieces, written

WHITE = b" \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCUMENTS = 3
#: Rows of a range partition; sets their number for large inputs.
PARTITION_ROWS = 1_000_000
_NULL_DOC = -(1 << 63)
_LINES = "h1 long, h2 long, doc long, rid long, pos int, n_lines int"


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).lower()


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _emit_lines(least: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches):
            out: list[list[int]] = [[], [], [], [], [], []]
            h1, h2, docs, rids, at, counts = out
            for doc, rid, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                lines = (text or "").encode("utf-8", "replace").split(b"\n")
                for pos, line in enumerate(lines):
                    if len(line) >= least and long_enough(key := line_key(line), least):
                        d = xxhash.xxh3_128_intdigest(key)
                        h1.append((d >> 64) - (1 << 63))
                        h2.append((d & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
                        docs.append(doc)
                        rids.append(rid)
                        at.append(pos)
                        counts.append(len(lines))
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=["h1", "h2", "doc", "rid", "pos", "n_lines"])

    return emit


def _columns(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a partition: its first and last hash, with the documents of those runs."""
    first = last = None  # [h1, h2, n documents, first document, last document]
    part, one_run = -1, True
    for batch in batches:
        if not batch.num_rows:
            continue
        part_, h1, h2, doc = _columns(batch, ["part", "h1", "h2", "doc"])
        part = int(part_[0])
        starts = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        ends = np.r_[starts[1:], len(h1)]
        for a, b in ((starts[0], ends[0]), *(((starts[-1], ends[-1]),) if len(starts) > 1 else ())):
            n = 1 + int(np.count_nonzero(doc[a + 1 : b] != doc[a : b - 1]))
            if last and (last[0], last[1]) == (h1[a], h2[a]):
                last[2] += n - (last[4] == doc[a])
                last[4] = int(doc[b - 1])
            else:
                if last:
                    one_run = False
                last = [int(h1[a]), int(h2[a]), n, int(doc[a]), int(doc[b - 1])]
            if one_run:
                first = list(last)
            elif first is None:
                first = list(last)
    if last:
        row = [part, *first[:3], first[3], first[4], *last[:3], last[3], last[4], one_run]
        names = ["part", "f1", "f2", "fn", "ff", "fl", "l1", "l2", "ln", "lf", "ll", "whole"]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=names)


_EDGES = "part long, f1 long, f2 long, fn long, ff long, fl long, l1 long, l2 long, ln long, lf long, ll long, whole boolean"


def _around(edges: list) -> dict[int, tuple]:
    """For each partition: (documents of its first hash before it, the last of them, documents of its last hash after it)."""
    rows = sorted(edges, key=lambda r: r["part"])
    out: dict[int, list] = {r["part"]: [0, None, 0] for r in rows}
    key, n, doc = None, 0, None  # the run that reaches the end of what has been seen
    for r in rows:
        if key == (r["f1"], r["f2"]):
            out[r["part"]][:2] = [n, doc]
            joined = n + r["fn"] - (doc == r["ff"])
        else:
            joined = r["fn"]
        key, n, doc = ((r["f1"], r["f2"]), joined, r["fl"]) if r["whole"] else ((r["l1"], r["l2"]), r["ln"], r["ll"])
    key, n, doc = None, 0, None  # the same from the end: the run that reaches back to the start of what has been seen
    for r in reversed(rows):
        if key == (r["l1"], r["l2"]):
            out[r["part"]][2] = n - (doc == r["ll"])
            joined = n + r["ln"] - (doc == r["ll"])
        else:
            joined = r["ln"]
        key, n, doc = ((r["l1"], r["l2"]), joined, r["lf"]) if r["whole"] else ((r["f1"], r["f2"]), r["fn"], r["ff"])
    return {k: tuple(v) for k, v in out.items()}


def _stream(edges: "pyspark.Broadcast", least: int):  # noqa: F821
    """Yield the rows that are dropped: in a run of at least `least` documents, all but those of its first document."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = edges.value
        key = doc_now = None
        rank, after, begun = 0, 0, False
        held: list[tuple] = []  # rows of the open run that go if it turns out long enough; of fewer than `least` documents
        out: list[tuple] = []

        def close(extra: int) -> None:
            if rank + extra >= least:
                out.extend(held)
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            part, h1, h2, doc, rid, pos, n_lines = _columns(batch, ["part", "h1", "h2", "doc", "rid", "pos", "n_lines"])
            before, last_doc, after = around[int(part[0])]
            change = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            starts = np.flatnonzero(change)
            ends = np.r_[starts[1:], len(h1)]
            many = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(h1)))
            for a, b in zip(starts[many], ends[many]):
                k = (int(h1[a]), int(h2[a]))
                if k != key:
                    close(0)
                    key, doc_now, rank = k, None, 0
                    if not begun:
                        doc_now, rank = last_doc, before
                begun = True
                docs = doc[a:b]
                new = np.r_[doc_now is None or docs[0] != doc_now, docs[1:] != docs[:-1]]
                ranks = rank + np.cumsum(new)
                rank, doc_now = int(ranks[-1]), int(docs[-1])
                if rank >= 2:
                    rows = np.flatnonzero(ranks >= 2)
                    if rank >= least:
                        close(0)
                        keep = out
                    else:
                        keep = held
                    keep.extend(zip(docs[rows].tolist(), rid[a:b][rows].tolist(), pos[a:b][rows].tolist(), n_lines[a:b][rows].tolist()))
            if len(out) > 20_000:
                yield _dropped(out)
                out.clear()
        close(after)
        yield _dropped(out)

    return stream


def _dropped(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int32()])], names=["doc", "rid", "pos", "n_lines"])


def pack_keep(positions: np.ndarray, n_lines: int) -> bytes:
    """A bitmap with a 1 for each kept line, compressed."""
    keep = np.ones(n_lines, np.uint8)
    keep[positions] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def unpack_keep(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_pieces(batches):
        maps, dropped = [], []
        for at, n in zip(batch.column("positions").to_pylist(), batch.column("n_lines").to_pylist()):
            at = np.unique(np.asarray(at, np.int64))
            maps.append(pack_keep(at, n))
            dropped.append(len(at))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("rid"), batch.column("n_lines"), pa.array(dropped, pa.int32()), pa.array(maps, pa.binary())], names=["doc", "rid", "n_lines", "n_dropped", "keep"])


def _identity() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_DOC)).alias("doc"), F.xxhash64("text").alias("rid")]


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(*_identity(), "text")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """doc, rid (hash of the text), n_lines, n_dropped, keep (compressed bitmap) of the documents that lose lines."""
    spark = docs.sparkSession
    lines = written(_identified(docs).mapInArrow(_emit_lines(min_chars), _LINES))
    # rows that repeat (doc_id, text) are one document: its lines count once, however many rows say them
    repeated = written(docs.select(*_identity()).groupBy("doc", "rid").agg(F.count("*").alias("n")).where("n > 1").select("doc", "rid"))
    if not repeated.isEmpty():
        lines = written(lines.join(small(repeated), ["doc", "rid"], "left_anti").unionByName(lines.join(small(repeated), ["doc", "rid"], "left_semi").distinct()))
    parts = max(shuffle_partitions(spark), math.ceil(lines.count() / PARTITION_ROWS))
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("rid"), F.col("pos")]
    ordered = checkpointed(lines.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long")))
    around = spark.sparkContext.broadcast(_around(ordered.mapInArrow(_edges, _EDGES).collect()))  # one row for each partition
    dropped = ordered.mapInArrow(_stream(around, min_documents), "doc long, rid long, pos int, n_lines int")
    grouped = dropped.groupBy("doc", "rid").agg(F.collect_set("pos").alias("positions"), F.max("n_lines").alias("n_lines"))
    return grouped.mapInArrow(_bitmaps, "doc long, rid long, n_lines int, n_dropped int, keep binary")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace text by its kept lines; adds n_lines and n_dropped."""
    for batch in text_pieces(batches):
        texts, lines_, dropped = [], [], []
        for text, keep in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist()):
            lines = (text or "").split("\n")
            kept = lines if keep is None else [x for x, ok in zip(lines, unpack_keep(keep, len(lines))) if ok]
            texts.append(text if keep is None else "\n".join(kept))
            lines_.append(len(lines))
            dropped.append(len(lines) - len(kept))
        cols = {n: batch.column(n) for n in batch.schema.names if n != "keep"} | {"text": pa.array(texts, pa.string()), "n_lines": pa.array(lines_, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """row (the other columns of docs), text (kept lines; null stays null), n_lines, n_dropped; a row for each input row."""
    maps = written(keep_bitmaps(docs, min_chars, min_documents))
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns if c != "text"]).alias("row"), "text", *_identity())
    cols = rows.join(small(maps.select("doc", "rid", "keep")), ["doc", "rid"], "left").select("row", "text", "keep")
    schema = T.StructType([cols.schema["row"], cols.schema["text"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return cols.mapInArrow(_apply, schema)


def replace_texts(docs: DataFrame) -> DataFrame:
    """docs with the kept lines as text and n_chars (where there is such a column) counted anew."""
    kept = drop_repeated_lines(docs)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return kept.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def line_dedup_report(docs: DataFrame) -> DataFrame:
    """The digest columns of the contract: doc_id, n_lines, n_dropped, kept_sha256."""
    kept = drop_repeated_lines(docs)
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple], min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> list[tuple]:
    """The same on a small list of (doc_id, text), for tests."""
    held: dict[bytes, set] = {}
    for doc, text in rows:
        for line in (text or "").encode().split(b"\n"):
            if len((key := line_key(line)).decode()) >= min_chars:
                held.setdefault(key, set()).add(_NULL_DOC if doc is None else doc)
    keeper = {k: max(v) for k, v in held.items() if len(v) >= min_documents}
    out = []
    for doc, text in rows:
        lines = (text or "").encode().split(b"\n")
        kept = [x for x in lines if keeper.get(line_key(x), _NULL_DOC if doc is None else doc) == (_NULL_DOC if doc is None else doc)]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    return out
