"""Mixing sources to target weights with fixed-length blocks.

The words of each source form one stream, its documents in a pseudorandom but repeatable order; the stream is cut into
blocks of fixed length (only its last block is short). The mix is a sequence of slots, dealt to output shards of equal
size; each slot takes one block. How many slots of a shard a source gets is a multinomial draw by target weight,
conditioned on the source's total over all shards, so that totals are exact while shards vary as they do in free draws:
a keyed permutation deals the slots of all sources over the shards, each slot on its own, and the counts of a source in the shards are
the draw. A source's j-th slot takes the block at place j of a
pseudorandom permutation of its blocks (both are keyed Feistel networks with cycle walking, for blocks a new one for each epoch), so no
list of blocks is shuffled or stored. Documents' segments then join their blocks by index.

A source's places in the stream come from sums in three levels (documents in a hash range of a source, ranges, groups of ranges), so
that a source with a third of all rows is no single task. Rows that are alike are counted, not sorted: each copy has a hash of its own.
Per-source totals (one row for each source, about 100 bytes) are on the driver and go to every task that plans slots; nothing else does.

Targets: all words are shared by weight (5, 2, 1 repeating over the sources by code point, null last). No source gets
more than `most` times its words; what is over goes to the others by weight, until none is above. The last block drawn
for a source is cut where its target is reached.

Cases: a null source is a source of its own, last in order. Null or empty texts have no words and are never taken. A very long text is many blocks.
Rows that share a doc_id are separate rows, in the order of a hash of their text; equal rows are told apart by number,
as they are alike. A null doc_id sorts by text. Sources without words get the target 0. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.common import small, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
BLOCK = 1024
SLOTS_PER_SHARD = 256
#: Rows of one hash range of a source, and ranges of a group.
RANGE_ROWS = 2_000
GROUP_RANGES = 1_000
#: Slots planned in one task.
TASK_SLOTS = 200_000
SEED = 20240229
WHITE = r"[\x20\x09-\x0D]"


def targets(words: list[int], weights: list[float], most: int = MOST) -> list[float]:
    """Share sum(words) by weight; what exceeds `most` times a source's words goes to the others, until none is above."""
    total, out, open_ = float(sum(words)), [0.0] * len(words), [i for i, n in enumerate(words) if n > 0]
    rest = total
    while open_:
        share = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / share > most * words[i]]
        if not over:
            for i in open_:
                out[i] = rest * weights[i] / share
            break
        for i in over:
            out[i] = float(most * words[i])
        rest = total - sum(out[i] for i in range(len(words)) if i not in open_ or i in over)
        open_ = [i for i in open_ if i not in over]
    return out


def permuted(j: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Place j of a pseudorandom permutation of 0..n-1 chosen by key, element by element."""
    j, n, key = (np.asarray(x).astype(np.uint64) for x in (j, n, key))
    half = np.ones(len(n), np.uint64)
    bits = np.ceil(np.log2(np.maximum(n.astype(np.float64), 2)) / 2).astype(np.uint64)
    bits = np.where((np.uint64(1) << (np.uint64(2) * bits)) < n, bits + np.uint64(1), bits)
    mask = (half << bits) - np.uint64(1)
    out, todo = j.copy(), np.ones(len(j), bool)
    while todo.any():
        x, b, m, k = out[todo], bits[todo], mask[todo], key[todo]
        left, right = x >> b, x & m
        for r in range(rounds):
            h = (right + k + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            left, right = right, left ^ (h & m)
        out[todo] = (left << b) | right
        todo &= out >= n  # walk on until inside
    return out.astype(np.int64)


def dealt(slot: np.ndarray, total: int, per_shard: int = SLOTS_PER_SHARD, seed: int = SEED) -> np.ndarray:
    """The shard of each slot: slots 0 to total - 1 in the order of a keyed permutation, cut into shards of sizes that differ by one at most."""
    shards = max(1, -(-total // per_shard))
    place = permuted(slot, np.full(len(slot), total), np.full(len(slot), seed))
    return place % shards


def n_words(text: Column) -> Column:
    """Words of a text, runs of what is no white space; null: 0."""
    edge = lambda at: F.substring(text, at, 1).rlike(WHITE).cast("int")
    return F.coalesce(F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.size(F.split(text, WHITE + "+")) - edge(1) - edge(-1)), F.lit(0)).cast("long")


def _summed_before(by: list[str], order: str, value: str) -> Column:
    """The sum of `value` over the rows of the same `by` that come before."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def located(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, at: each row's size and place in its source's stream of words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"), F.xxhash64(F.lit(SEED), F.col("doc_id").cast("long"), "text").alias("order"))
    alike = rows.groupBy("doc_id", "source", "size", "order").agg(F.count("*").alias("copies"))
    each = alike.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("order", F.when(F.col("copy") == 0, F.col("order")).otherwise(F.xxhash64("order", "copy")))
    rows = written(each.drop("copies"))
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    rows = rows.withColumn("range", F.floor((F.col("order").cast("double") + 2.0**63) / 2.0**64 * ranges).cast("long"))
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("n")).withColumn("grp", F.floor(F.col("range") / GROUP_RANGES))
    sums = written(sums)
    groups = sums.groupBy("source", "grp").agg(F.sum("n").alias("n"))
    groups = groups.select(F.col("source").alias("s"), F.col("grp").alias("g"), _summed_before(["source"], "grp", "n").alias("base"))
    inner = sums.withColumn("begin", _summed_before(["source", "grp"], "range", "n"))
    starts = written(inner.join(small(written(groups)), F.col("source").eqNullSafe(F.col("s")) & (F.col("grp") == F.col("g"))).select("s", F.col("range").alias("r"), (F.col("base") + F.col("begin")).alias("begin")))
    placed = rows.join(small(starts), F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    inside = Window.partitionBy("source", "range").orderBy("order", "doc_id", "size", "copy").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "source", "size", (F.col("begin") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("at"))


def _plan(source_no: np.ndarray, starts: np.ndarray, blocks: np.ndarray, tails: np.ndarray, total: int, seed: int, per_shard: int):
    """id (of a slot, over all sources) -> shard, source_no, slot (of its source), block."""

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["id"].to_numpy(np.int64)
            if not len(ids):
                continue
            s = np.searchsorted(starts, ids, "right") - 1
            j = ids - starts[s]
            epoch, block = j // blocks[s], j % blocks[s]
            full = blocks[s] - (tails[s] > 0)  # the short last block stands last in every epoch
            inner = np.flatnonzero(block < full)
            if len(inner):
                key = (np.uint64(seed % 1_000_003) * np.uint64(1_000_003) + source_no[s[inner]].astype(np.uint64)) * np.uint64(1_000_003) + epoch[inner].astype(np.uint64)
                block[inner] = permuted(block[inner], full[inner], key)
            yield pd.DataFrame({"shard": dealt(ids, total, per_shard, seed), "source_no": source_no[s], "slot": j, "block": block})

    return plan


def mix(docs: DataFrame, block: int = BLOCK, seed: int = SEED, most: int = MOST, weights: tuple[float, ...] = WEIGHTS, per_shard: int = SLOTS_PER_SHARD) -> tuple[DataFrame, DataFrame]:
    """(rows, manifest).

    rows: doc_id, source, size, source_size, target, row_no. manifest: what the mix takes, one row for each slot and document in its block: shard, slot,
    source_no, block, row_no, first (place of the first word taken in the document's words), words.
    """
    spark = docs.sparkSession
    rows = written(located(docs).withColumn("row_no", F.monotonically_increasing_id()))
    totals = sorted(((r["source"], int(r["n"])) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()), key=lambda x: (x[0] is None, x[0] or ""))  # one row for each source
    sizes = [n for _, n in totals]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(totals))], most)
    want = [min(round(g), most * n) for g, n in zip(goal, sizes)]  # words to take, whole
    blocks, tails = [-(-n // block) for n in sizes], [n % block for n in sizes]
    slots = [(w // n) * b + -(-(w % n) // block) if n else 0 for w, n, b in zip(want, sizes, blocks)]
    # words of the last slot of a source, where it is cut; a slot elsewhere takes its whole block
    cut = [(w % n) - ((-(-(w % n) // block)) - 1) * block if n and w % n else block for w, n in zip(want, sizes)]
    info = spark.createDataFrame([(x, i, n, g, s, c) for i, ((x, n), g, s, c) in enumerate(zip(totals, goal, slots, cut))], "s string, source_no int, source_size long, target double, slots long, cut long")
    joined = rows.join(small(info), F.col("source").eqNullSafe(F.col("s"))).drop("s")

    total = sum(slots)
    source_no = np.flatnonzero(slots)  # those with slots
    per_source = [np.array(x, np.int64)[source_no] for x in (np.cumsum(slots) - slots, blocks, tails)]
    planned = spark.range(0, total, 1, max(1, -(-total // TASK_SLOTS))).mapInPandas(_plan(source_no, *per_source, total, seed, per_shard), "shard long, source_no int, slot long, block long")
    cuts = small(info.select("source_no", (F.col("slots") - 1).alias("last"), "cut"))
    planned = planned.join(cuts, "source_no").select("shard", "source_no", "slot", "block", F.when(F.col("slot") == F.col("last"), F.col("cut")).otherwise(F.lit(block)).alias("most"))

    has = joined.where("size > 0 and slots > 0").select("row_no", "source_no", "size", "at")
    parts = has.withColumn("block", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")))
    parts = parts.withColumn("begin", F.greatest(F.col("at"), F.col("block") * block) - F.col("block") * block).withColumn("end", F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - F.col("block") * block)
    taken = parts.join(planned, ["source_no", "block"]).withColumn("words", F.least("end", "most") - F.col("begin")).where("words > 0")
    manifest = taken.select("shard", "slot", "source_no", "block", "row_no", (F.col("block") * block + F.col("begin") - F.col("at")).alias("first"), "words")
    return joined.select("doc_id", "source", "size", "source_size", "target", "row_no"), manifest


def mixing_report(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, taken; a row for each input row."""
    rows, manifest = mix(docs, block)
    taken = manifest.groupBy("row_no").agg(F.sum("words").alias("taken"))
    return rows.join(taken, "row_no", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
