import math

from shoebox.operators import clustering, vectors


def test_small_clusters_are_consolidated_within_each_group(spark):
    turn = lambda a: [math.cos(math.radians(a)), math.sin(math.radians(a))]
    # in either group a single face beside a cluster of four; the groups lie on one another
    rows = [(g * 10 + i, g * 10 + (5 if i == 5 else 0), g, turn(a), True) for g in (1, 2) for i, a in enumerate((0, 1, 2, 3, 3.5, 4))]
    faces = spark.createDataFrame(rows, "id bigint, cluster_id bigint, group_id bigint, vec array<double>, movable boolean")
    got = {r.id: r.cluster_id for r in clustering.consolidate(faces, 0.1, group="group_id").collect()}
    assert got == {r[0]: r[2] * 10 for r in rows}
    near = vectors.knn(faces, faces, 3, group="group_id").collect()
    assert len(near) == 36 and all(r.id // 10 == r.other // 10 for r in near)


def test_regroup_consolidates_with_several_groups(spark, monkeypatch):
    seen = []
    real = clustering.consolidate
    monkeypatch.setattr(clustering, "consolidate", lambda *a, **k: seen.append(k) or real(*a, **k))
    rows = [(i, 1 if i < 3 else None, [1.0, 0.01 * i]) for i in range(6)]
    clustering.regroup(spark.createDataFrame(rows, "id bigint, person_id bigint, vec array<double>"), 0.15)
    assert seen == [{"group": "group_id"}]
