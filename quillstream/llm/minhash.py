"""Near-duplicate detection by b-bit MinHash.

1. Every text becomes the set of 64-bit hashes of its distinct word shingles. Texts with the same set form a class,
   named by a fingerprint of the set; groups of copies are folded here, before anything is compared.
2. Each class gets `bands * rows` minima. Full minima only form the band keys; of each minimum two low bits are kept,
   packed in bit planes, and similarity is estimated from bit counts, corrected for chance collisions.
3. Candidates: each member of a band bucket against the bucket's centre (linear in the bucket). Estimates, by bit
   counts inside the join, far below
   the threshold go; the rest is confirmed on full sets. Confirmed links give components.
4. What a star can miss are links between members whose components still differ inside a bucket. In each such bucket,
   the rows outside its largest component are compared with all its rows:
   by bit counts of a wider signature inside the join, then on full sets. Pairs of one component need no test. A bucket is dealt
   in cells of at most about CELL x CELL rows, so that none is one task's work. Where a bucket would give more than PAIRS pairs (many texts
   on one template, at a similarity well below the threshold), its members get longer band keys instead, of more minima and with as many bands as keep the chance to
   miss a pair at the threshold at MISS; groups that are still too large get longer ones again, up to LONGEST rows.
5. Components are closed by alternating star contraction; every round is written to the shared folder.

With 40 bands of 6 rows a pair at similarity 0.8 shares no bucket with probability 5e-6. The estimate must fall by
more than 0.125 (4 standard deviations at 240 minima) to lose a link. Buckets hold no cap. The centre of a bucket is
its member with most neighbours over all buckets: among edited copies of one text that is the text itself, to which
most of them link, though they need not link to each other.

Cases: null or empty texts, or texts of white space only, have no shingles, size 0 and no links. Texts of fewer words
than a shingle have one shingle, the whole sequence. Very long texts are read whole. Repeated rows are copies; rows sharing a doc_id stay separate
rows. A null doc_id keeps its row and counts as larger than every other id, so a component made only of such rows has
a null id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import hashed_words, mix, pieces, small, text_buffer, text_pieces, written

BANDS, ROWS = 40, 6
BITS = 2
MARGIN = 0.125
#: Minima of the wide signature that sifts what the stars leave, and its margin (4 standard deviations).
WIDE, WIDE_MARGIN = 1024, 0.06
#: Rows of a side of a bucket that one task compares; pairs of a bucket beyond which longer keys split it; rows of the first longer keys, steps, and the last.
CELL, PAIRS = 1024, 1 << 24
LONGER, STEP, LONGEST = 12, 4, 24
MISS = 6e-6
#: A text has many copies if they are more than HOT_COPIES and than a HOT_TEXTS-th of all rows.
HOT_COPIES, HOT_TEXTS = 1_000, 100_000
_C = [np.uint64(x) for x in (0x9DDFEA08EB382D69, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_multipliers = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after the other, and the documents' offsets in them."""
    words, at = hashed_words(raw, offsets)
    n_docs, n_words = len(at) - 1, np.diff(at)
    n_sh = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    off = np.r_[0, np.cumsum(n_sh)]
    first = np.repeat(at[:-1] - off[:-1], n_sh) + np.arange(off[-1])
    s = np.zeros(off[-1], np.uint64)
    full = np.repeat(n_words >= k, n_sh)
    for j in range(k):
        s[full] = mix(s[full] * _C[0] + words[first[full] + j] + np.uint64(j + 1))
    for d in np.flatnonzero((n_words > 0) & (n_words < k)):  # the whole short sequence
        h = np.zeros(1, np.uint64)
        for j in range(at[d], at[d + 1]):
            h = mix(h * _C[0] + words[j] + np.uint64(j - at[d] + 1))
        s[off[d]] = mix(h + np.uint64(n_words[d]))[0]
    bounds = off.tolist()
    for d in range(n_docs):
        s[bounds[d] : bounds[d + 1]].sort()
    if not len(s):
        return s, off
    new = np.r_[True, s[1:] != s[:-1]]
    new[off[:-1][n_sh > 0]] = True
    kept = np.r_[0, np.cumsum(new)]
    return s[new], kept[off]


def _minima(s: np.ndarray, starts: np.ndarray, n: int, first: int = 0) -> np.ndarray:
    """n minima for each (non-empty) set: least of the set under n multiplicative hashes, n x sets."""
    out = np.empty((n, len(starts)), np.uint64)
    for j in range(n):
        out[j] = np.minimum.reduceat(s * _multipliers[first + j], starts)
    return out


def pack_bits(minima: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of mixed minima, in bit planes of whole 64-bit words: sets x (bits * words of a plane)."""
    low = mix(minima.copy())
    pad = -len(low) % 64
    planes = []
    for b in range(bits):
        plane = np.packbits(((low >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T, axis=1)
        planes.append(np.ascontiguousarray(np.pad(plane, ((0, 0), (0, pad // 8)))).view(np.int64))
    return np.concatenate(planes, axis=1)


def unequal_minima(a: str, b: str, n: int, bits: int = BITS) -> Column:
    """How many of n retained b-bit minima differ, by bit counts over packed signatures (arrays of 64-bit words)."""
    width = -(-n // 64)
    words = ("|".join(f"({a}[{p * width + i}] ^ {b}[{p * width + i}])" for p in range(bits)) for i in range(width))
    return F.expr(" + ".join(f"bit_count({w})" for w in words))


def most_unequal(n: int, similarity: float, bits: int = BITS) -> int:
    """The count that estimates `similarity`: b-bit minima of unequal values agree by chance with probability 2**-bits."""
    return int(n * (1 - similarity) * (1 - 0.5**bits))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _fingerprint(s: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit name for each (non-empty) set."""
    return _signed(mix(np.add.reduceat(mix(s ^ _C[1]), starts) + n.astype(np.uint64) * _C[2]))


def _sign(k: int, bands: int, rows: int):
    """doc_id, text, rid -> doc_id, rid, node (fingerprint of the set; null if empty), n_shingles, signature, band keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches):
            raw, offsets = text_buffer(batch.column("text"))
            for a, b in pieces(offsets):
                at = offsets[a : b + 1]
                s, off = shingle_sets(raw[at[0] : at[-1]], at - at[0], k)
                n = np.diff(off)
                has = np.flatnonzero(n)
                sig, keys, nodes = [None] * (b - a), [None] * (b - a), [None] * (b - a)
                if len(has):
                    starts = off[:-1][has]
                    minima = _minima(s, starts, bands * rows)
                    node = _fingerprint(s, starts, n[has])
                    packed = pack_bits(minima)
                    band = np.zeros((bands, len(has)), np.uint64)
                    for r in range(rows):
                        band = mix(band * _C[3] + minima[r::rows])
                    band = _signed(mix(band + np.arange(1, bands + 1, dtype=np.uint64)[:, None] * _C[1])).T.copy()
                    for i, d in enumerate(has.tolist()):
                        nodes[d], sig[d], keys[d] = int(node[i]), packed[i], band[i]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("rid").slice(a, b - a), pa.array(nodes, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "rid", "node", "n_shingles", "sig", "bands"],
                )

    return sign


def _sets(k: int, wide: int = 0, first: int = 0):
    """node, text -> node, the text's own node, set (sorted 64-bit hashes; or a signature of `wide` minima)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches):
            raw, offsets = text_buffer(batch.column("text"))
            for a, b in pieces(offsets):
                at = offsets[a : b + 1]
                s, off = shingle_sets(raw[at[0] : at[-1]], at - at[0], k)
                has = np.flatnonzero(np.diff(off))
                own = np.zeros(b - a, np.int64)
                if len(has):
                    own[has] = _fingerprint(s, off[:-1][has], np.diff(off)[has])
                if wide:
                    made: list = [None] * (b - a)
                    for d, row in zip(has.tolist(), pack_bits(_minima(s, off[:-1][has], wide, first)) if len(has) else ()):
                        made[d] = row
                    last = pa.array(made, pa.list_(pa.int64()))
                else:
                    last = pa.array([s[x:y].tobytes() for x, y in zip(off[:-1], off[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), pa.array(own), last], names=["node", "found", "sig" if wide else "set"])

    return sets


def _multiplier(j: int) -> np.uint64:
    return _multipliers[j] if j < len(_multipliers) else np.uint64(mix(np.array([j], np.uint64) * _C[1])[0] | np.uint64(1))


def longer_bands(rows: int, percent: int) -> int:
    """Bands of `rows` minima with which a pair at the threshold shares none with probability MISS."""
    return int(np.ceil(np.log(MISS) / np.log1p(-((percent / 100) ** rows))))


def _keys(k: int, bands: int, rows: int):
    """node, text -> node, the text's own node, keys of `bands` bands of `rows` minima."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches):
            raw, offsets = text_buffer(batch.column("text"))
            for a, b in pieces(offsets):
                at = offsets[a : b + 1]
                s, off = shingle_sets(raw[at[0] : at[-1]], at - at[0], k)
                has = np.flatnonzero(np.diff(off))
                own, made = np.zeros(b - a, np.int64), [None] * (b - a)
                if len(has):
                    own[has] = _fingerprint(s, off[:-1][has], np.diff(off)[has])
                    found = np.empty((bands, len(has)), np.uint64)
                    for band in range(bands):
                        key = np.full(len(has), np.uint64((band + 1) * int(_C[1]) % (1 << 64)))
                        for r in range(rows):
                            key = mix(key * _C[3] + np.minimum.reduceat(s * _multiplier(4096 + (rows * 100_000) + band * rows + r), off[:-1][has]))
                        found[band] = key
                    for d, row in zip(has.tolist(), _signed(found).T.copy()):
                        made[d] = row
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), pa.array(own), pa.array(made, pa.list_(pa.int64()))], names=["node", "found", "keys"])

    return keys


def _confirm(percent: int):
    """Keep the pairs with 100 * intersection >= percent * union, counted on full sets."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches):
            ok = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return confirm


def components(edges: DataFrame) -> DataFrame:
    """node, component (least node reachable) for the nodes of edges (a, b), by alternating large and small stars."""

    def least(e: DataFrame) -> tuple[DataFrame, DataFrame]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        return both, both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))

    now, before = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), None
    while True:
        both, m = least(now)
        large = both.join(m, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        m2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small_ = large.join(m2, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = written(small_.where("a != b").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
        before = state


def _mixed(member: DataFrame, comp: DataFrame) -> DataFrame:
    """bucket, node, component of the buckets whose members lie in several components."""
    labelled = member.join(comp, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    several = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("bucket")
    return written(labelled.join(several, "bucket"))


def _cells(labelled: DataFrame, facts: DataFrame, likely: Column, most: int | None = None, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """(likely pairs (a, b) of a bucket in different components, nodes of the buckets with more than `most` pairs, which are left out; None: there are no such).

    once: facts has bands, the buckets of each node; a pair counts in its first common bucket only.
    """
    counts = labelled.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    largest = counts.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n_all")).select("bucket", F.col("top.component").alias("top"), "n_all", (F.col("n_all") - F.col("top.n")).alias("n_rest"))
    largest = written(largest)
    large = F.lit(False) if most is None else F.col("n_all") * F.col("n_rest") > most
    fits = largest.where(~large)
    heavy = labelled.join(largest.where(large).select("bucket"), "bucket", "left_semi").select("node").distinct()
    cells = lambda n: F.ceil(F.col(n) / CELL).cast("int")
    place = lambda n: F.pmod(F.xxhash64("node"), cells(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), cells(n) - 1))
    named = lambda x: (F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("sig").alias(f"sig_{x}"), F.col("component").alias(f"comp_{x}"), *([F.col("bands").alias(f"bands_{x}")] if once else []))
    rows = labelled.join(fits, "bucket")
    rest = rows.where("component != top").withColumn("row", place("n_rest")).withColumn("col", every("n_all"))
    others = rows.withColumn("row", every("n_rest")).withColumn("col", place("n_all"))
    rest = rest.join(facts, "node").select("bucket", "row", "col", "top", *named("a"))
    others = others.join(facts, "node").select("bucket", "row", "col", *named("b"))
    pairs = rest.join(others, ["bucket", "row", "col"]).where((F.col("comp_a") != F.col("comp_b")) & ((F.col("comp_b") == F.col("top")) | (F.col("a") < F.col("b"))) & likely & (F.expr("array_intersect(bands_a, bands_b)[0] = bucket") if once else F.lit(True)))
    return pairs.select("a", "b").distinct(), written(heavy)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each input row: doc_id, rid (hash of the text), n_shingles, node, component, component_id (least doc_id reachable), n_texts (classes in the component)."""
    n_minima = bands * rows
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(docs.withColumn("rid", F.xxhash64("text")).mapInArrow(_sign(k, bands, rows), "doc_id long, rid long, node long, n_shingles long, sig array<long>, bands array<long>"))
    # a class of equal sets is one node, one of its rows stands for it; ids that are null come last
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("rep")
    classes = written(signed.where("node is not null").groupBy("node").agg(rep, F.first("n_shingles").alias("size"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.count("*").alias("copies")))
    member = classes.select("node", F.explode("bands").alias("bucket"))
    buckets = member.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")  # buckets of one class go before anything is joined with them
    member = written(member.join(buckets, "bucket"))
    degree = member.groupBy("node").agg(F.sum("n").alias("degree"))
    facts = written(classes.select("node", "size", "sig").join(degree, "node"))
    centres = member.join(degree, "node").groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("top")).select("bucket", F.col("top.node").alias("centre"))
    side = lambda x: facts.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("sig").alias(f"sig_{x}"))
    alike = lambda n, margin: F.expr(f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)") & (unequal_minima("sig_a", "sig_b", n) <= most_unequal(n, percent / 100 - margin))

    def from_texts(needed: DataFrame, made, kind: str) -> DataFrame:
        """What `made` makes of the texts of some nodes."""
        reps = small(classes.join(needed.distinct(), "node", "left_semi").select("node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.rid").alias("rep_rid")))
        texts = docs.join(reps, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.xxhash64("text") == F.col("rep_rid"))).select("node", "text")
        # texts of one hash may differ: the set's own fingerprint picks the right one
        return written(texts.mapInArrow(made, f"node long, found long, {kind}").where("node = found").drop("found").dropDuplicates(["node"]))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that pass the exact count."""
        pairs = written(pairs)
        sets = from_texts(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), _sets(k), "set binary")
        joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
        return written(joined.mapInArrow(_confirm(percent), "a long, b long"))

    stars = member.join(centres, "bucket").where("node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    stars = written(stars.join(side("a"), "a").join(side("b"), "b").where(alike(n_minima, MARGIN)).select("a", "b"))
    comp = written(components(confirmed(stars)))

    labelled = _mixed(member.select("bucket", "node"), comp)
    wide = from_texts(labelled.select("node"), _sets(k, WIDE, n_minima), "sig array<long>").join(classes.select("node", "size", "bands"), "node")
    more, heavy = _cells(labelled, wide, alike(WIDE, WIDE_MARGIN), PAIRS, once=True)
    for longer in range(LONGER, LONGEST + 1, STEP):
        if heavy.isEmpty():
            break
        keyed = from_texts(heavy, _keys(k, longer_bands(longer, percent), longer), "keys array<long>")
        labelled = _mixed(keyed.select(F.explode("keys").alias("bucket"), "node"), comp)
        found, heavy = _cells(labelled, wide, alike(WIDE, WIDE_MARGIN), PAIRS if longer + STEP <= LONGEST else None)  # in the end, pairs right at the threshold have to be looked at
        more = more.union(found)
    tried = stars.union(stars.select("b", "a"))
    links = confirmed(more.distinct().join(tried, ["a", "b"], "left_anti"))
    # the components so far are stars already: they and the new links are all that is left to close
    stars_now = comp.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a != b")
    comp = written(components(stars_now.unionByName(links)))

    reps = classes.select("node", F.col("rep.doc_id").alias("rep"))
    linked = written(reps.join(comp.unionByName(comp.select(F.col("component").alias("node"), "component").distinct()), "node"))  # a component's name is its least node
    ids = linked.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n_texts"))
    linked = linked.join(small(written(ids)), "component").select("node", "component", "component_id", "n_texts")
    by_node = classes.select("node", F.col("rep.doc_id").alias("rep"), "copies").join(linked, "node", "left")
    by_node = written(by_node.select("node", "copies", F.coalesce("component", "node").alias("component"), F.when(F.col("n_texts").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_texts", F.lit(1)).alias("n_texts")))
    # texts with many copies are fewer than HOT_TEXTS and join by broadcast, so that no task gets all copies of one
    out = signed.select("doc_id", "rid", "n_shingles", "node")
    many = F.col("copies") > max(HOT_COPIES, signed.count() // HOT_TEXTS)
    hot, rest = small(by_node.where(many).drop("copies")), by_node.where(~many).drop("copies")
    named = out.join(hot, "node").unionByName(out.join(hot.select("node"), "node", "left_anti").join(rest, "node", "left"))
    return named.select("doc_id", "rid", "n_shingles", "node", "component", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_texts", F.lit(1)).alias("n_texts"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component with all its columns: the one with the least doc_id (nulls last), then the least hash of its text; documents without words all stay.

    Rows that repeat (doc_id, text) stay once: the one whose columns have the least hash.
    """
    found = written(near_duplicates(docs, k, percent).select("doc_id", "rid", "node", "component"))
    first = found.where("node is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("x")).select("x.doc_id", "x.rid")
    kept = written(first.unionByName(found.where("node is null").select("doc_id", "rid").distinct()).select(F.col("doc_id").alias("kept_id"), F.col("rid").alias("kept_rid")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    is_ = lambda id_, rid: F.col("row.doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64("row.text") == F.col(rid))
    rows = rows.join(kept, is_("kept_id", "kept_rid"), "left_semi")
    repeated = found.groupBy(F.col("doc_id").alias("id"), F.col("rid").alias("id_rid")).agg(F.count("*").alias("n")).where("n > 1").select("id", "id_rid")
    repeated = small(written(repeated))
    one = rows.join(repeated, is_("id", "id_rid")).groupBy("id", "id_rid").agg(F.min_by("row", F.xxhash64(*[F.col("row")[c] for c in docs.columns])).alias("row")).select("row")
    return rows.join(repeated, is_("id", "id_rid"), "left_anti").unionByName(one).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def brute_force(rows: list[tuple], k: int, percent: int = 80) -> list[tuple]:
    """(doc_id, n_shingles, component_id) of a small list of (doc_id, text), by all pairs, for tests."""
    import re

    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    inverted: dict = {}
    for i, s in enumerate(sets):
        seen: dict = {}
        for x in s:
            for j in inverted.setdefault(x, []):
                seen[j] = seen.get(j, 0) + 1
            inverted[x].append(i)
        for j, n in seen.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least: dict = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return [(doc, len(s), least[root(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets))]
