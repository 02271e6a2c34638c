"""Approximate nearest neighbours with a hierarchical k-means tree and best-bin-first search.

Fit: the tree is grown by k-means at every node on a bounded sample (SAMPLE_ROWS, the rows with the least hash; all
rows below that), over vectors scaled to unit length, until a node has at most LEAF_SAMPLE of the sample. Its size is
bounded by the sample. Every vector of the table goes down the tree to a leaf.

Search: for each query a priority queue holds the branches passed by, nearest centre first; leaves are visited in that
order (best bin first). How many leaves a query visits is calibrated: a bounded sample of queries, rows the tree wasn't
fitted on (where the table has such), is answered exactly, block by block, over all rows, and the number of leaves grows until the calibrated recall at k reaches the goal (and
each query goes on until its leaves hold k candidates). Queries then join the rows by cell, a cell being neighbouring
leaves with about BLOCK_ROWS rows together: a query is sent once to each cell with leaves on its list and compared with
the rows of those leaves only. A leaf holding more rows is a cell of its own, split in blocks by a hash; a query goes to
all of them, so no task gets an unbounded leaf. In a block, equal vectors are compared once and give their k + 1 least ids; scores are cosines in double precision of the original
vectors, ties going to the smaller id.

Cases: vectors that are null, zero, or hold null or non-finite components take no part as queries or candidates, nor do
vectors whose length differs from the most frequent one (ties: the shorter). Null ids take no part. Repeated rows of
one id count as that id once, with its nearest copy. With fewer than k candidates all are returned. An empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.common import small, written

TOP = 5
SAMPLE_ROWS = 20_000
LEAF_SAMPLE = 48
BRANCHES = 8
CALIBRATION_QUERIES = 256
RECALL = 0.97
#: Rows of a block of one leaf.
BLOCK_ROWS = 4096
_HITS = "query_id long, vec_id long, score double"


def usable(df: DataFrame) -> DataFrame:
    """vec_id, embedding (array<double>) of the rows that take part."""
    v = F.col("embedding")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    fine = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.where(fine)
    width = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("embedding") == (width["d"] if width else -1))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1: cosines stay as they are to the last bit, and no square overflows."""
    _, power = np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))
    return np.ldexp(x, -power)


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


class Tree:
    """centres[i], children[i] (empty: a leaf, numbered leaf[i])."""

    def __init__(self, sample: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_SAMPLE, seed: int = 11):
        self.children: list[np.ndarray] = []
        self.centres: list[np.ndarray] = []
        self.leaf: list[int] = []
        self.n_leaves = 0
        rng = np.random.Generator(np.random.PCG64(seed))
        self._grow(sample, branches, leaf_rows, rng)

    def _node(self) -> int:
        self.children.append(np.zeros(0, np.int64))
        self.centres.append(np.zeros((0, 0)))
        self.leaf.append(-1)
        return len(self.leaf) - 1

    def _grow(self, x: np.ndarray, branches: int, leaf_rows: int, rng: np.random.Generator) -> int:
        me = self._node()
        distinct = np.unique(x, axis=0) if len(x) > leaf_rows else x
        if len(distinct) <= leaf_rows:
            self.leaf[me], self.n_leaves = self.n_leaves, self.n_leaves + 1
            return me
        centres = distinct[rng.choice(len(distinct), branches, replace=False)]
        for _ in range(8):
            near = (distinct @ centres.T).argmax(axis=1)
            for b in range(branches):
                if (near == b).any():
                    c = distinct[near == b].mean(axis=0)
                    centres[b] = c / max(np.linalg.norm(c), 1e-12)
        near = (distinct @ centres.T).argmax(axis=1)
        full = [b for b in range(branches) if (near == b).any()]
        if len(full) == 1:
            self.leaf[me], self.n_leaves = self.n_leaves, self.n_leaves + 1
            return me
        self.centres[me] = centres[full]
        self.children[me] = np.array([self._grow(distinct[near == b], branches, leaf_rows, rng) for b in full])
        return me

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        out = np.zeros(len(x), np.int64)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            near = (x[rows] @ self.centres[node].T).argmax(axis=1)
            stack += [(int(child), rows[near == b]) for b, child in enumerate(self.children[node]) if (near == b).any()]
        return out

    def visit(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        heap = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            while self.leaf[node] < 0:
                near = self.centres[node] @ q
                best = int(near.argmax())
                for b, child in enumerate(self.children[node]):
                    if b != best:
                        heapq.heappush(heap, (-float(near[b]), int(child)))
                node = int(self.children[node][best])
            yield self.leaf[node]


def _best(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, leaf: np.ndarray | None = None, visited: list | None = None) -> pd.DataFrame:
    """The k nearest rows of one block for each query: exact cosines, ties to the smaller id, the query's own id left out.

    With leaf (of each row) and visited (each query's leaves), only rows of visited leaves are candidates.
    """
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], np.ascontiguousarray(x[order])
    _, first, same = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
    at = np.argsort(same, kind="stable")  # rows grouped by vector, least id first
    at = at[np.r_[True, (same[at][1:] != same[at][:-1]) | (ids[at][1:] != ids[at][:-1])]] if len(at) else at  # repeated rows once
    begin = np.r_[0, np.cumsum(np.bincount(same[at], minlength=len(first)))]
    vectors = _scaled(x[first])
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    unit = _unit(vectors)
    own = leaf[order][first] if leaf is not None else None
    out_q, out_v, out_s = [], [], []
    for a in range(0, len(q), 256):
        part = _scaled(q[a : a + 256])
        rough = _unit(part) @ unit.T
        if own is not None:
            for i, leaves in enumerate(visited[a : a + 256]):
                rough[i, ~np.isin(own, leaves)] = -np.inf
        keep = min(k + 1, rough.shape[1])
        floor = -np.partition(-rough, keep - 1, axis=1)[:, keep - 1] - 1e-9
        for i in range(len(part)):
            near = np.flatnonzero((rough[i] >= floor[i]) & (rough[i] > -np.inf))
            exact = (vectors[near] * part[i]).sum(axis=1) / (norms[near] * np.sqrt((part[i] * part[i]).sum()))
            rows = [(-s, int(v)) for s, n in zip(exact.tolist(), near.tolist()) for v in ids[at[begin[n] : begin[n + 1]]][: k + 1].tolist() if v != qids[a + i]]
            found: dict[int, float] = {}
            for s, v in sorted(rows):
                if v not in found:
                    found[v] = -s
                if len(found) == k:
                    break
            out_q += [int(qids[a + i])] * len(found)
            out_v += list(found)
            out_s += list(found.values())
    return pd.DataFrame({"query_id": np.array(out_q, np.int64), "vec_id": np.array(out_v, np.int64), "score": np.array(out_s, np.float64)})


def top(hits: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best hits."""
    by_id = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return by_id.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(rows: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """All rows against a bounded set of queries, block by block, each block sending k hits for a query."""
    asked = queries.toPandas()  # the caller bounds it
    qids, q = asked["vec_id"].to_numpy(np.int64), _matrix(asked["embedding"]) if len(asked) else None

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) and q is not None:
                yield _best(batch["vec_id"].to_numpy(np.int64), _matrix(batch["embedding"]), qids, q, k)

    return top(rows.mapInPandas(scan, _HITS), k)


class Index:
    """The fitted tree and the table of all rows with their leaf and block."""

    def __init__(self, df: DataFrame, sample_rows: int = SAMPLE_ROWS, recall: float = RECALL, k: int = TOP):
        self.k, self.spark = k, df.sparkSession
        rows = usable(df)
        total = rows.count()
        some = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, sample_rows / max(total, 1)) * (1 << 30)))
        # the calibration queries are taken first, a quarter of a small table at most, and the tree isn't fitted on them
        self.held = written(rows.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(max(1, min(CALIBRATION_QUERIES, total // 4))).dropDuplicates(["vec_id"]))
        others = rows.join(F.broadcast(self.held.select("vec_id")), "vec_id", "left_anti")  # bounded by CALIBRATION_QUERIES
        sample = others.where(some).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()
        if not len(sample):
            sample = rows.limit(sample_rows).toPandas()  # tables of a few rows
        self.total = total
        if not total:
            return
        unit = _unit(_matrix(sample["embedding"]))
        self.tree = Tree(unit)
        tree = self.spark.sparkContext.broadcast(self.tree)  # bounded by the sample

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield batch.assign(leaf=tree.value.assign(_unit(_matrix(batch["embedding"]))))

        # rows that repeat count once, before they can fill a block
        repeated = written(rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"))
        if not repeated.isEmpty():
            rows = rows.join(small(repeated), "vec_id", "left_anti").unionByName(rows.join(small(repeated), "vec_id", "left_semi").distinct())
        self.rows = written(rows.mapInPandas(assign, "vec_id long, embedding array<double>, leaf long"))
        sizes = self.rows.groupBy("leaf").agg(F.count("*").alias("n"), F.countDistinct(F.xxhash64("vec_id")).alias("ids")).toPandas()  # bounded by the leaves
        self.ids = np.zeros(self.tree.n_leaves, np.int64)
        self.ids[sizes["leaf"].to_numpy()] = sizes["ids"].to_numpy()
        rows_of = np.zeros(self.tree.n_leaves, np.int64)
        rows_of[sizes["leaf"].to_numpy()] = sizes["n"].to_numpy()
        self.cell, self.blocks, held = np.zeros(self.tree.n_leaves, np.int64), [], 0
        for leaf, n in enumerate(rows_of.tolist()):  # leaves are numbered in the order of the tree
            if not self.blocks or held + n > BLOCK_ROWS:
                self.blocks.append(1)
                held = 0
            held += n
            self.cell[leaf] = len(self.blocks) - 1
            self.blocks[-1] = max(1, -(-held // BLOCK_ROWS))
        self.visits = self._calibrate(recall)

    def _calibrate(self, recall: float) -> int:
        """Widen the visits until the calibration queries' exact neighbours are in the visited leaves."""
        asked = self.held
        truth = exact(self.rows.select("vec_id", "embedding"), asked, self.k)
        leaves = truth.join(self.rows.select("vec_id", "leaf"), "vec_id").groupBy("query_id", "vec_id").agg(F.min("leaf").alias("leaf")).groupBy("query_id").agg(F.collect_list("leaf").alias("leaves")).toPandas()
        vectors = {int(r.vec_id): np.asarray(r.embedding, float) for r in asked.toPandas().itertuples()}
        found = np.zeros(self.tree.n_leaves + 1, np.int64)
        for r in leaves.itertuples():
            place = {leaf: i for i, leaf in enumerate(self.tree.visit(_unit(vectors[int(r.query_id)][None, :])[0]))}
            for leaf in r.leaves:
                found[place[leaf]] += 1
        share = np.cumsum(found) / max(1, found.sum())
        visits = int(np.argmax(share >= recall)) + 1 if found.sum() else self.tree.n_leaves
        self.measured = float(share[min(visits, len(share)) - 1]) if found.sum() else 1.0
        return visits

    def search(self, queries: DataFrame) -> DataFrame:
        """query_id, rank, vec_id, score for queries (vec_id, embedding)."""
        if not self.total:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        k, visits = self.k, self.visits
        state = self.spark.sparkContext.broadcast((self.tree, self.ids, self.cell, self.blocks))

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tree, ids, cell, blocks = state.value
            for batch in batches:
                out: list[tuple] = []
                for qid, v in zip(batch["vec_id"], batch["embedding"]):
                    leaves, held = [], 0
                    for leaf in tree.visit(_unit(np.asarray(v, float)[None, :])[0]):
                        if len(leaves) >= visits and held > k:
                            break
                        leaves.append(leaf)
                        held += ids[leaf]
                    own = np.array(leaves)
                    for c in np.unique(cell[own]):
                        out += [(int(qid), v, int(c), b, own[cell[own] == c]) for b in range(blocks[c])]
                yield pd.DataFrame(out, columns=["query_id", "embedding", "cell", "block", "leaves"])

        def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            _, _, cell, blocks = state.value
            n = np.array(blocks, np.int64)
            for batch in batches:
                c = cell[batch["leaf"].to_numpy(np.int64)]
                yield batch.assign(cell=c, block=np.mod(batch["hash"].to_numpy(np.int64), n[c])).drop(columns="hash")

        def compare(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
            return _best(left["vec_id"].to_numpy(np.int64), _matrix(left["embedding"]), right["query_id"].to_numpy(np.int64), _matrix(right["embedding"]), k, left["leaf"].to_numpy(np.int64), right["leaves"].tolist())

        asked = queries.mapInPandas(route, "query_id long, embedding array<double>, cell long, block long, leaves array<long>")
        rows = self.rows.withColumn("hash", F.xxhash64("vec_id", "embedding")).mapInPandas(placed, "vec_id long, embedding array<double>, leaf long, cell long, block long")
        hits = rows.groupBy("cell", "block").cogroup(asked.groupBy("cell", "block")).applyInPandas(compare, _HITS)
        return top(hits, k)


def search_report(df: DataFrame, k: int = TOP, every: int = 50) -> DataFrame:
    """Every row whose id is divisible by `every` against all rows; recall: the share of true neighbours found for the calibration queries."""
    index = Index(df, k=k)
    asked = usable(df).where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    found = index.search(asked)
    return found.withColumn("recall", F.lit(index.measured)) if index.total else found.withColumn("recall", F.lit(None).cast("double"))
