"""Blocks that are multiplied tile by tile, and strips of blocks."""

import numpy as np
from pyspark.sql import functions as F

from shoebox.operators import pivots, vectors


def test_tiles_give_what_whole_products_do(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 7)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[11:31] = x[10]  # ties beyond any k
    d = np.round(1 - x @ x.T, 6)
    near = vectors.Nearest(np.arange(60), x, 4, 6)
    for s in (slice(30, 60), slice(0, 30)):
        near.look(np.arange(60)[s], x[s])
    want = [[j for _, j in sorted((d[i, j], j) for j in range(60) if j != i)[:4]] for i in range(60)]
    assert near.other.tolist() == want
    few = vectors.Nearest(np.arange(3), x[:3], 4, 6)
    few.look(np.arange(3), x[:3])
    assert len(few.found()[0]) == 6
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    for block in (13, 100):
        monkeypatch.setattr(vectors, "BLOCK", block)
        got = {(r.id, r.other): r.distance for r in vectors.pairs_within(df, 0.4).collect()}
        assert got == {(i, j): d[i, j] for i in range(60) for j in range(i + 1, 60) if d[i, j] <= 0.4}


def test_blocks_of_pivots_meet_by_strips(spark, monkeypatch):
    """A strip hands on k of a query, however many blocks it has."""
    monkeypatch.setattr(pivots, "STRIP", 8)
    v = spark.range(400).select("id", F.expr("array(cos(radians(id * 0.9)), sin(radians(id * 0.9)))").alias("vec"))
    held = pivots.blocks(v, pivots.choose(v, 8), 50)
    pairs = held.select(F.col("block").alias("i")).crossJoin(held.select(F.col("block").alias("j")))
    strips = -(-held.count() // 8)
    assert pivots.scored(pairs, held, held, 3, 6).count() <= 400 * 3 * strips < 400 * 3 * held.count()
