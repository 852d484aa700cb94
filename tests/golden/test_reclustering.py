"""Detached faces are grouped anew, pool by pool, as the library's own cases ask."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.library import Library
from shoebox.operators import clustering, mutations, reclustering

at = lambda degrees: [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]


@pytest.fixture
def make(spark):
    def build(faces, clusters, people=((1, "Anna"),)):
        """faces: (id, degrees or None, cluster, status)."""
        face = spark.createDataFrame([(i, i, float(i), c, s) for i, _, c, s in faces], "id bigint, image_id bigint, bbox_x double, cluster_id bigint, review_status string")
        image = spark.createDataFrame([(f[0],) for f in faces], "id bigint")
        lib = Library(spark.createDataFrame(list(people), "id bigint, name string"), spark.createDataFrame(list(clusters), "id bigint, label string, person_id bigint"), image, image.select(F.col("id").alias("image_id")), face)
        return lib, spark.createDataFrame([(i, at(d)) for i, d, _, _ in faces if d is not None], "id bigint, vec array<double>")

    return build


def clusters_of(lib):
    return {r.id: r.cluster_id for r in lib.face.collect()}


def test_removed_faces_go_to_nobodys_cluster_not_to_a_persons(make):
    lib, vec = make([(1, 0, 7, "active"), (2, 0, 8, "active"), (3, 0, 9, "active"), (4, 0, 7, "active")], [(7, "source", 1), (8, "inbox", None), (9, "other", 1)])
    out = mutations.remove_faces(lib, 7, [1], vec, 0.5)
    assert clusters_of(out) == {1: 8, 2: 8, 3: 9, 4: 7}
    assert {r.person_id for r in out.recluster_dirty_person.collect()} == {1}
    with pytest.raises(LookupError):
        mutations.remove_faces(lib, 7, [2], vec, 0.5)


def test_removed_faces_never_return_to_their_cluster(make):
    lib, vec = make([(1, 0, 7, "active"), (2, 0, 7, "active"), (3, 1, 7, "active")], [(7, None, None)])
    got = clusters_of(mutations.remove_faces(lib, 7, [1, 2], vec, 0.5))
    assert got == {1: 8, 2: 8, 3: 7}


def test_restored_faces_stay_out_of_a_persons_cluster(make):
    lib, vec = make([(1, 0, 7, "not_face"), (2, 0, 7, "active")], [(7, "a", 1)])
    out = mutations.restore_faces(lib, [1], vec, 0.5)
    assert clusters_of(out) == {1: 8, 2: 7} and {r.person_id for r in out.recluster_dirty_person.collect()} == {1}


def test_a_deleted_persons_faces_are_grouped(make):
    lib, vec = make([(1, 0, 7, "active"), (2, 1, 7, "not_face"), (3, 90, 7, "active"), (4, 91, 8, "active")], [(7, "a", 1), (8, None, None)])
    out = mutations.delete_person(lib, 1, "unassigned", vec, 0.1)
    assert clusters_of(out) == {1: 9, 2: 9, 3: 8, 4: 8} and out.person.count() == 0


def test_loose_faces_are_repaired_and_blind_ones_stand_alone(make):
    lib, vec = make([(1, 0, None, "active"), (2, 0, None, "active"), (3, None, None, "active"), (4, None, None, "active"), (5, 0, None, "not_face")], [(3, "empty", None)])
    out = mutations.recluster_inbox(lib, vec, 0.5)
    assert clusters_of(out) == {1: 4, 2: 4, 3: 5, 4: 6, 5: None}
    assert {r.id for r in out.cluster.collect()} == {4, 5, 6}
    again = mutations.recluster_inbox(out, vec, 0.5)
    assert clusters_of(again) == clusters_of(out)


def test_a_wide_cluster_is_dissolved_and_split(make):
    lib, vec = make([(i, d, 7, "active") for i, d in enumerate((0, 30, 60, 90), 1)] + [(9, 0, 8, "active")], [(7, "old", None), (8, "b", 1)])
    got = clusters_of(mutations.rebuild_pool(lib, vec, 0.15))
    assert got == {1: 9, 2: 9, 3: 10, 4: 10, 9: 8}


def test_pools_change_no_decision(spark, monkeypatch):
    """Many bunches of faces in few dimensions, some known: the same clusters as with all in one pool, and no pool of more than a bunch."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(25, 24))
    rows = []
    for i in range(400):
        v = centres[i % 25] + 0.12 * rng.normal(size=24)
        rows.append((i + 1, (v / np.linalg.norm(v)).tolist(), 1000 + i % 25 if i % 5 == 0 and i % 2 else None))
    faces = spark.createDataFrame(rows, "id bigint, vec array<double>, cluster_id bigint").repartition(5)
    new, known = faces.where("cluster_id is null").select("id", "vec"), faces.where("cluster_id is not null")
    targets, held = reclustering.pools(new, known, 0.2)
    sizes = sorted(r["count"] for r in targets.groupBy("group_id").count().collect())
    assert len(sizes) >= 20 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    apart = dict(map(tuple, reclustering.regroup_loose(new, known, 0.2).collect()))
    one = F.lit(0).cast("bigint").alias("group_id")
    monkeypatch.setattr(reclustering, "pools", lambda new, known, threshold: (new.select("*", one), known.select("*", one)))
    assert apart == dict(map(tuple, reclustering.regroup_loose(new, known, 0.2).collect()))
    assert len(apart) == 360 and {c for c in apart.values() if c > 0} == {1000 + i for i in range(25) if i % 5 == 0}


def test_marks_follow_edits(make):
    people = ((1, "Anna"), (2, "Bob"))
    lib, _ = make([(1, 0, 7, "active"), (2, 0, 7, "active"), (3, 0, 8, "active")], [(7, "a", 1), (8, "b", 2)], people)
    dirty = lambda out: {r.person_id for r in out.recluster_dirty_person.collect()}
    assert dirty(mutations.archive_faces(lib, [1], "not_face")) == {1}
    assert dirty(mutations.rename_person(lib, 2, "anna ")) == {1, 2}
    assert dirty(mutations.assign_faces(lib, [1], "Bob")) >= {1, 2}
    ids = lib.face.where("id = 3").select("id")
    assert dirty(mutations.archive_faces(lib, ids, "unknown_person")) == {2}


def test_kept_prototypes_follow_their_cluster():
    rng = random.Random(2)
    work = clustering.Assigner(0.3)
    work.load(np.array([at(a) for a in range(0, 60, 2)]), [1] * 30, [5] * 30)
    for _ in range(40):
        work.add(np.array(at(rng.uniform(0, 60))))
        assert np.allclose(work._prototypes(1), clustering.select_prototypes(work.rows[work.members[1]]))
