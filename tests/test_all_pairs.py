"""Scores of all pairs: rounding, what is dealt out, and what the result takes on disk."""

import numpy as np
from pyspark.sql import functions as F

from quillstream.operators import nearest, retrieval


def test_all_pairs_are_rounded_as_the_sums_in_order_are(monkeypatch):
    monkeypatch.setattr(nearest, "RUN", 700)
    monkeypatch.setattr(nearest, "BATCH", 64)
    rng = np.random.default_rng(3)
    some = rng.standard_normal((50, 8)).astype("float32").astype(float)
    halves = np.array([[np.cos(a), np.sin(a), *[0] * 6] for a in np.arccos(np.arange(5, 105, 10) / 1e7)])  # next to half a millionth with the first axis
    odd = np.array([[0.0] * 8, [1.0, *[0] * 7], [1e-170] * 8, [3e-162] * 8, [1e-150, 2e-150, *[0] * 6]])
    for x in (np.concatenate([some, halves, odd[:2]]), np.concatenate([some, odd])):
        q, batches = x[::-1], list(nearest.every(x, x[::-1]))
        assert all(len(j) == len(i) == len(score) <= 64 for j, i, score in batches)
        got = {(int(b), int(a)): v for j, i, score in batches for b, a, v in zip(j, i, score)}
        assert len(got) == len(x) * len(q) == sum(len(j) for j, _, _ in batches)
        (nx, nq), total = (nearest.lengths(y.T) for y in (x, q)), np.zeros((len(q), len(x)))
        for c in range(8):
            total += np.multiply.outer(q[:, c], x[:, c])
        want = nearest.millionths(nearest._cosine(total.ravel(), np.multiply.outer(nq, nx).ravel())) / 1e6
        assert [got[b, a] for b in range(len(q)) for a in range(len(x))] == want.tolist()


def test_all_pairs_take_few_bytes_in_files_and_few_copies(spark, tmp_path):
    angle = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) * 0.6e-6
    rows = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.cos(angle).cast("float"), F.sin(angle).cast("float")).alias("embedding"))
    asked = spark.range(2500).select((F.col("id") + 10_000).alias("qid"), F.array(F.sin(angle + 0.7).cast("float"), F.cos(angle + 0.7).cast("float")).alias("query"))
    store, none = spark._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList

    def dealt() -> int:
        stages = store.stageList(none(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = dealt()
    retrieval.scored(rows, asked).write.parquet(str(tmp_path / "pairs"))
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    assert dealt() - before < 3000 + 3 * 2500 + 500
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 3000 * 2500
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 6 * 3000 * 2500
