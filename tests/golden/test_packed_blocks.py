"""Blocks that are packed once and read where they stand."""

import time

import numpy as np

from shoebox.operators import vectors


def shuffled(spark):
    """Bytes that the session's tasks have written for shuffles so far."""
    time.sleep(1)  # the figures come a little later than the results
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()


def test_rows_are_not_copied_for_each_block(spark, monkeypatch):
    """Ten blocks: ten copies would be 5 MB, the vectors are 0.5 MB."""
    monkeypatch.setattr(vectors, "BLOCK", 200)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[700:710] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, vec array<double>").repartition(4)
    before = shuffled(spark)
    got = [tuple(r) for r in vectors.pairs_within(df, 0.5).collect()]
    assert 0 < shuffled(spark) - before < 2 << 20
    d = np.round(1 - x @ x.T, 6)
    i, j = np.nonzero(np.triu(d <= 0.5, 1))
    assert sorted(got) == [(a, b, d[a, b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)] and len(got) > 55


def test_rows_without_an_id_or_a_vector_have_no_pairs(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.8, 0.6]), (2, [1.0, 0.0]), (None, [1.0, 0.0]), (4, None), (5, [float("nan"), 0.0]), (6, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>")
    assert sorted(map(tuple, vectors.pairs_within(df, 0.3).collect())) == [(1, 2, 0.0), (1, 2, 0.2)]
    assert vectors.pairs_within(df.where("false"), 0.3).count() == 0
