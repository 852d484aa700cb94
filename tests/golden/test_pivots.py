"""Pruned searches give the rows of the plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.operators import pivots, tuning, vectors


def table(spark, n, dims, spread, seed, groups=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    x = centres[np.arange(n) % groups] + spread * rng.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7], x[8] = x[5], x[5]  # ties
    rows = [(i, int(i % groups), int(i % groups * 3 + i % 3), v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, person_id bigint, cluster_id bigint, vec array<double>").repartition(4)


@pytest.mark.parametrize("spread", [0.1, 2.0])
def test_neighbours_over_ten_blocks(spark, spread):
    v = table(spark, 640, 16, spread, 1, 8)
    want = sorted(map(tuple, vectors.knn(v, v, 5).select("id", "other", "distance", "rank").collect()))
    found, looked = pivots.knn(v, v, 5, block=64)
    assert sorted(map(tuple, found.collect())) == want
    n = looked.select("i").distinct().count()
    assert n >= 10
    if spread < 1:
        assert looked.count() < 0.5 * n * n


def test_neighbours_of_few_and_none(spark):
    v = table(spark, 9, 4, 1.0, 2, 3)
    some = v.where("id < 4")
    found, _ = pivots.knn(some, v, 20, block=4)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, vectors.knn(some, v, 20).select("id", "other", "distance", "rank").collect()))
    assert pivots.knn(v, v.where("false"), 3)[0].count() == 0 and pivots.knn(v.where("false"), v, 3)[0].count() == 0


@pytest.mark.parametrize("spread", [0.2, 1.5])
def test_distances_to_people_without_a_row_for_each(spark, spread, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 60)
    v = table(spark, 300, 12, spread, 3).withColumn("person_id", F.when(F.col("id") != 299, F.col("person_id")).otherwise(99))
    all_ = tuning.group_distances(v, "person_id").withColumnRenamed("person_id", "g").join(v.select("id", "person_id"), "id")
    want = {r.id: (r.pos, r.neg) for r in all_.groupBy("id").agg(F.min(F.when(F.col("g") == F.col("person_id"), F.col("distance"))).alias("pos"), F.min(F.when(F.col("g") != F.col("person_id"), F.col("distance"))).alias("neg")).collect()}
    got = {r.id: (r.pos, r.neg) for r in tuning.person_distances(v.drop("cluster_id")).collect()}
    assert got.keys() == want.keys()
    for i, (pos, neg) in want.items():
        assert (pos is None) == (got[i][0] is None) and (pos is None or abs(pos - got[i][0]) < 1e-9) and abs(neg - got[i][1]) < 1e-9


def test_grid_counts_faces_at_their_first_threshold(spark):
    rows = [(1, 0.0, 0.3), (1, 0.07, 0.29), (1, None, 1.5), (2, 0.29, None), (2, 1.0, 0.57), (3, None, 0.0), (3, 1.2, 0.1 + 0.2)]
    got = {round(r.threshold * 100): (r.same, r.other) for r in tuning.tune_grid(spark.createDataFrame(rows, "person_id bigint, pos double, neg double")).collect()}
    for g in range(101):
        rates = []
        for k, hit in ((1, lambda x: x <= g / 100.0), (2, lambda x: x > g / 100.0)):  # noqa: B023
            people = [[hit(r[k]) for r in rows if r[0] == p and r[k] is not None] for p in (1, 2, 3)]
            rates.append(np.mean([np.mean(x) for x in people if x]))
        assert np.allclose(got[g], rates)
