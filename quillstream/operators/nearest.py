"""Cosines of blocks of vectors inside a task, and the best of them.

A block product finds the rows that can be among a question's best; their scores add up the products in the order of the components, in double precision, as the
column expressions in functions.vectors do, and are rounded as Spark rounds. Where all pairs are asked for, that is done for those that a block product can't round
safely. So results don't depend on the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: A block product may be off by much less than this, and rounding to six places moves a score by half a millionth.
SLACK = 2e-6
#: Questions whose scores are in memory together.
STEP = 64
#: Pairs that are sorted by score together (8 bytes each), and rows of a batch of all pairs.
RUN, BATCH = 1 << 25, 1 << 18
#: Squares of shorter vectors lose figures, so that a product of unit vectors isn't near their cosine.
TINY = 1e-100


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), float).reshape(len(flat), -1)


def lengths(columns: np.ndarray) -> np.ndarray:
    """The lengths of vectors given as a matrix of components by vectors."""
    total = np.zeros(columns.shape[1])
    for c in columns:
        total += c * c
    return np.sqrt(total)


def _unit(x: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.divide(x, length[:, None], out=np.zeros_like(x), where=length[:, None] > 0)


def millionths(score: np.ndarray) -> np.ndarray:
    """Scores in whole millionths, half away from zero by their decimal figures."""
    scaled = np.abs(score) * 1e6
    out = np.floor(scaled + 0.5)
    half = np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6)
    if len(half):
        values, which = np.unique(np.abs(score[half]), return_inverse=True)
        out[half] = np.array([float(Decimal(repr(float(v))).scaleb(6).to_integral_value(ROUND_HALF_UP)) for v in values])[which]
    return np.where(score < 0, -out, out) + 0.0


def _cosine(total: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.divide(total, length, out=np.zeros_like(total), where=length != 0)


def best(x: np.ndarray, q: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Questions, rows and scores to six places of the k best rows of each question, ties to the earlier row. least: for each question a score that k rows are known to have."""
    xt, qt = np.ascontiguousarray(x.T), np.ascontiguousarray(q.T)
    nx, nq = lengths(xt), lengths(qt)
    ux, uq = _unit(x, nx), _unit(q, nq)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(q), STEP):
        near = uq[a : a + STEP] @ ux.T
        if least is not None:
            bound = least[a : a + STEP]
        elif len(x) > k:
            bound = np.partition(near, len(x) - k, axis=1)[:, len(x) - k]
        else:
            bound = np.full(len(near), -np.inf)
        j, i = np.nonzero(near >= bound[:, None] - SLACK)
        j += a
        total = np.zeros(len(i))
        for c in range(len(xt)):
            total += xt[c][i] * qt[c][j]
        m = millionths(_cosine(total, nx[i] * nq[j]))
        order = np.lexsort((i, -m, j))
        j, i, m = j[order], i[order], m[order]
        kept = np.arange(len(j)) - np.searchsorted(j, j, "left") < k
        found.append((j[kept], i[kept], m[kept] / 1e6))
    return tuple(np.concatenate(part) for part in zip(*found))


def _whole(xt: np.ndarray, qt: np.ndarray, nx: np.ndarray, nq: np.ndarray, ux: np.ndarray, uq: np.ndarray) -> np.ndarray:
    """Cosines in whole millionths, questions by rows. What a product of unit vectors leaves next to a half is added up in the order of the components."""
    scaled = uq @ ux.T
    scaled *= 1e6
    out = np.rint(scaled)
    scaled -= out
    tiny = any(((n > 0) & (n < TINY)).any() for n in (nx, nq))
    j, i = np.nonzero(np.abs(scaled, out=scaled) > (-1 if tiny else 0.5 - 1e-6 - 1e-9 * len(xt)))
    total = np.zeros(len(i))
    for c in range(len(xt)):
        total += xt[c][i] * qt[c][j]
    out[j, i] = millionths(_cosine(total, nx[i] * nq[j]))
    return out


def every(x: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Questions, rows and scores to six places of all pairs, in batches. The pairs of some questions come by rising score: so files hold a score once for many rows."""
    xt, qt = np.ascontiguousarray(x.T), np.ascontiguousarray(q.T)
    nx, nq = lengths(xt), lengths(qt)
    ux, uq = _unit(x, nx), _unit(q, nq)
    some = max(1, RUN // len(x))
    for a in range(0, len(q), some):
        n = min(some, len(q) - a)
        keys = np.empty(n * len(x), np.int64)
        for b in range(0, n, STEP):
            part = slice(a + b, a + min(b + STEP, n))
            run = keys[b * len(x) : (b + STEP) * len(x)]
            run[:] = _whole(xt, qt[:, part], nx, nq[part], ux, uq[part]).ravel()
            run <<= 32
            run += np.arange(b * len(x), b * len(x) + len(run))
        keys.sort()
        for b in range(0, len(keys), BATCH):
            part = keys[b : b + BATCH]
            j, i = np.divmod(part & 0xFFFFFFFF, len(x))
            yield a + j, i, (part >> 32) / 1e6


def met(k: int, names: tuple[str, ...]):
    """A function for a pair of groups, vectors (vec_id, embedding, names..) and questions (qid, query): qid, vec_id, names.., score of the k best."""

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            rows, asked = rows.slice(0, 0), asked.slice(0, 0)
            j, i, score = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        else:
            rows = rows.take(pa.compute.sort_indices(rows["vec_id"], null_placement="at_start"))
            x, q = matrix(rows["embedding"]), matrix(asked["query"])
            j, i, score = best(x, q, k)
        out = {"qid": asked["qid"].combine_chunks().take(pa.array(j)), "vec_id": rows["vec_id"].combine_chunks().take(pa.array(i))}
        out |= {n: rows[n].combine_chunks().take(pa.array(i)) for n in names}
        return pa.table(out | {"score": score})

    return meet


def paired(names: tuple[str, ...]):
    """A function for a group of vectors (vec_id, vector, names..) and questions (qid, vector), which asks marks: qid, vec_id, names.., score of all pairs."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        asks = table["asks"].combine_chunks()
        rows, asked = table.filter(pa.compute.invert(asks)), table.filter(asks)
        if not rows.num_rows or not asked.num_rows:
            return
        qid, shown = asked["qid"].combine_chunks(), {n: rows[n].combine_chunks() for n in ("vec_id", *names)}
        for j, i, score in every(matrix(rows["vector"]), matrix(asked["vector"])):
            yield pa.RecordBatch.from_pydict({"qid": qid.take(pa.array(j))} | {n: x.take(pa.array(i)) for n, x in shown.items()} | {"score": score})

    return pair
