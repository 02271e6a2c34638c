"""Toxicity by cumulative-link ordinal regression on sparse text features.

Grades of severity are ordered: 0 a sound text, 1 a poor one (quality 0), 2 a toxic one. One weight vector is shared by
all thresholds: P(grade >= k) = sigmoid(w.x - t_k), with t_1 <= t_2. Features are hashed: the distinct words of a text (runs
of letters, lower-cased) and their prefixes of PREFIXES bytes, present or not. The weights are fitted by proximal gradient
steps with a light L1 and L2 penalty, after a score test has left only features that go with severity.

The model is fitted on a bounded sample of labelled documents (FIT_ROWS, those with the least hash; all of them below
that). Every document is then graded, each on its own and whole; results are the expected severity (the sum of P(grade >= k)),
the most probable grade, and whether grade 2 is likelier than not (toxic).

A severity thus tells a poor text (near 1) from a toxic one (near 2): `toxic` is what marks toxic texts.

Cases: null or empty texts, or texts without a letter, have severity 0 and grade 0. Very long texts are read whole, their distinct features
counting once. Grades that are equally probable give the smaller one. Of rows that share a labelled doc_id the text that comes first by code point is fitted on. Labels with a null doc_id, toxic or quality train
nothing; several labels of one document: the largest grade counts. Without labels of at least two grades everything is grade 0.
A null doc_id is kept. Rows that repeat get a result each. An empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import letter_features, pieces, text_buffer, text_pieces

BUCKETS = 1 << 22
PREFIXES = (5, 6, 7)
FIT_ROWS = 6_000
ROUNDS = 1000
#: The penalty is L1_ROOT / sqrt(rows), as the noise of a mean falls.
L1_ROOT = 0.0005
L2 = 1e-5
#: Score test a feature must pass, in standard deviations.
LEAST_Z = 5.0
#: Features of fewer documents of the sample get no weight.
LEAST_DOCUMENTS = 3
GRADES = 3


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of each document, one after the other, and the documents' offsets in them."""
    hashes, doc = letter_features(raw, offsets, PREFIXES)
    key = np.unique((doc.astype(np.uint64) << np.uint64(32)) | (hashes >> np.uint64(42)))
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int32), np.searchsorted(key >> np.uint64(32), np.arange(len(offsets)).astype(np.uint64))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _only(idx: np.ndarray, off: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sparse rows with the features in `some` only."""
    keep = some[idx]
    return idx[keep], np.r_[0, np.cumsum(keep)][off]


class Ordinal:
    """weights and thresholds of a cumulative-link model; sparse rows are (indices, offsets)."""

    def __init__(self, buckets: int = BUCKETS, grades: int = GRADES):
        self.w = np.zeros(buckets)
        self.t = np.arange(1, grades, dtype=float)

    def _score(self, idx: np.ndarray, off: np.ndarray) -> np.ndarray:
        out = np.zeros(len(off) - 1)
        full = np.flatnonzero(np.diff(off))
        if len(full):
            out[full] = np.add.reduceat(self.w[idx], off[full])
        return out

    def above(self, idx: np.ndarray, off: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, rows x (grades - 1)."""
        return _sigmoid(self._score(idx, off)[:, None] - self.t)

    def fit(self, idx: np.ndarray, off: np.ndarray, grade: np.ndarray, rounds: int = ROUNDS, l1: float | None = None, l2: float = L2) -> "Ordinal":
        """Screen the features by the score test of no weight, then descend on those that pass."""
        n, counts = len(grade), np.diff(off)
        self._start(grade)
        pull = self._pull(np.zeros(n), grade)
        pull = pull - pull.mean()
        seen = np.bincount(idx, minlength=len(self.w))
        z = np.bincount(idx, np.repeat(pull, counts), len(self.w)) / np.sqrt(np.maximum(seen * pull.var(), 1e-12))
        self._descend(*_only(idx, off, (np.abs(z) >= LEAST_Z) & (seen >= LEAST_DOCUMENTS)), grade, rounds, L1_ROOT / np.sqrt(n) if l1 is None else l1, l2)
        return self

    def _start(self, grade: np.ndarray) -> None:
        n = len(grade)
        share = np.array([max((grade >= k).mean(), 0.5 / n) for k in range(1, len(self.t) + 1)])
        self.t = np.maximum.accumulate(-np.log(share / (1 - np.minimum(share, 1 - 0.5 / n))))

    def _pull(self, score: np.ndarray, grade: np.ndarray) -> np.ndarray:
        """Minus the slope of each row's loss in its score."""
        row = np.arange(len(grade))
        p = np.c_[np.ones(len(grade)), _sigmoid(score[:, None] - self.t), np.zeros(len(grade))]
        slope = p * (1 - p)  # of P(grade >= k); 0 for the two outer ones
        return (slope[row, grade] - slope[row, grade + 1]) / np.maximum(p[row, grade] - p[row, grade + 1], 1e-12)

    def _descend(self, idx: np.ndarray, off: np.ndarray, grade: np.ndarray, rounds: int, l1: float, l2: float) -> None:
        """Accelerated proximal gradient on the features that occur; each feature has its own step."""
        n, counts, used = len(grade), np.diff(off), np.unique(idx)
        if not len(used):
            return
        idx, row = np.searchsorted(used, idx), np.arange(n)
        m = len(used)
        apply = lambda w: np.bincount(np.repeat(row, counts), w[idx], n)
        back = lambda r: np.bincount(idx, np.repeat(r, counts), m)
        # a bound of the curvature for each feature: its rows, times what else is in them
        step = 1 / (0.5 * back(counts + float(len(self.t))) / n + l2)
        step_t = 1 / (0.5 * (counts.max() + len(self.t)))
        w, t = np.zeros(m), self.t.copy()
        yw, yt, speed = w.copy(), t.copy(), 1.0
        for _ in range(rounds):
            self.t = yt
            score = apply(yw)
            p = np.c_[np.ones(n), _sigmoid(score[:, None] - yt), np.zeros(n)]
            own = np.maximum(p[row, grade] - p[row, grade + 1], 1e-12)
            gt = np.array([((grade == k) * 1.0 - (grade == k - 1)) @ (p[:, k] * (1 - p[:, k]) / own) / n for k in range(1, len(yt) + 1)])
            new = yw - step * (back(-self._pull(score, grade) / n) + l2 * yw)
            new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
            new_t = np.maximum.accumulate(yt - step_t * gt)
            faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
            if ((yw - new) / step) @ (new - w) > 0:  # start over where the momentum points uphill
                faster = 1.0
            pull = (speed - 1) / faster if faster > 1 else 0.0
            yw, yt, w, t, speed = new + pull * (new - w), np.maximum.accumulate(new_t + pull * (new_t - t)), new, new_t, faster
        self.w[used], self.t = w, t


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_pieces(batches):
        raw, offsets = text_buffer(batch.column("text"))
        for a, b in pieces(offsets):
            at = offsets[a : b + 1]
            idx, off = features(raw[at[0] : at[-1]], at - at[0])
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(idx, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("grade").slice(a, b - a), lists], names=["grade", "features"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Ordinal | None:
    graded = labels.where("doc_id is not null and toxic is not null and quality is not null")
    graded = graded.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.when(F.col("toxic") > 0, 2).when(F.col("quality") > 0, 0).otherwise(1)).alias("grade"))
    total = graded.count()
    if not total:
        return None
    order = F.xxhash64("id")
    bound = min(1.0, 0.9 * rows / total if total > rows else 1.0)
    some = graded.where(F.pmod(order, F.lit(1 << 30)) < int(bound * (1 << 30))).orderBy(order, "id").limit(rows)  # a bounded sample to fit on
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(some), "id").where("text is not null")
    joined = texts.groupBy("id", "grade").agg(F.min("text").alias("text")).select("grade", "text")  # one text for each id: the first by code point
    got = joined.mapInArrow(_featurise, "grade int, features array<int>").toPandas()
    if got["grade"].nunique() < 2:
        return None
    off = np.r_[0, np.cumsum(got["features"].map(len).to_numpy())]
    return Ordinal().fit(np.concatenate(got["features"].to_list()).astype(np.int64), off, got["grade"].to_numpy(int))


def grade(docs: DataFrame, model: Ordinal | None) -> DataFrame:
    """doc_id, severity, grade, toxic; a row for each input row."""
    shared = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(model.w), model.w[model.w != 0], model.t) if model else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None
        if shared.value is not None:
            m = Ordinal()
            m.w[shared.value[0]] = shared.value[1]
            m.t = shared.value[2]
        for batch in text_pieces(batches):
            raw, offsets = text_buffer(batch.column("text"))
            above = np.zeros((batch.num_rows, GRADES - 1))
            for a, b in pieces(offsets) if m else ():
                at = offsets[a : b + 1]
                idx, off = features(raw[at[0] : at[-1]], at - at[0])
                above[a:b] = m.above(idx, off) * (np.diff(off) > 0)[:, None]
            p = np.c_[np.ones(len(above)), above, np.zeros(len(above))]
            likeliest = (p[:, :-1] - p[:, 1:]).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(above.sum(axis=1)), pa.array(likeliest, pa.int32()), pa.array(above[:, -1] >= 0.5)], names=["doc_id", "severity", "grade", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, severity double, grade int, toxic boolean")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return grade(docs, fit(docs, labels))
