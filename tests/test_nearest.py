"""Nearest vectors with many queries: what a task holds is bounded."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from weftgraph.functions import embed


def test_ties_across_parts_of_batches(spark, monkeypatch):
    rows = [(i, [float(i % 3), 1.0]) for i in range(60)] + [(60, None), (61, [0.0, 0.0])]
    v = spark.createDataFrame(rows, "vid long, vec array<double>").repartition(3)
    q = v.where("vid % 7 = 0").select(F.col("vid").alias("qid"), F.col("vec").alias("q"))
    want = set()
    for a, x in ((i, x) for i, x in rows if i % 7 == 0 and x):
        near = sorted((-round(float(np.dot(x, y) / max(np.linalg.norm(x) * np.linalg.norm(y), 1e-12)), 9), b) for b, y in rows if y and b != a)
        want |= {(a, b) for _, b in near[:4]}
    assert {(r.qid, r.vid) for r in embed.nearest(v, q, 4).collect()} == want


def test_first_of_each_row():
    rng = np.random.default_rng(1)
    cos = rng.integers(0, 4, (50, 37)).astype(float)
    vid = np.broadcast_to(rng.permutation(37), cos.shape)
    for k in (1, 5, 36, 37, 40):
        got_cos, got = embed._first(cos, vid, k)
        for i in range(50):
            assert set(got[i]) == {v for _, v in sorted(zip(-cos[i], vid[i]))[:k]}


def test_a_batch_and_many_queries_take_bounded_memory(spark):
    import pyarrow as pa

    n, size, seen = 3000, 8, {}

    class Vectors:
        sparkSession = spark

        def __getattr__(self, name):
            return lambda *a, **k: self

        def mapInArrow(self, run, schema):
            seen["run"] = run
            raise InterruptedError

    rng = np.random.default_rng(2)
    q = spark.createDataFrame([(i, rng.random(size).tolist()) for i in range(n)], "qid long, q array<double>")
    try:
        embed._nearest(Vectors(), q, 5)
    except InterruptedError:
        pass
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(rng.random((10_000, size)).tolist())], ["vid", "vec"])
    tracemalloc.start()
    got = sum(b.num_rows for b in seen["run"](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == 5 * n
    assert peak < 150e6
