"""Cases worked by hand: effective distances, suggestions, names, paths and deletions."""

import math

import pytest
from pyspark.sql import functions as F

from shoebox.functions.text import rename_of
from shoebox.library import Library, violations
from shoebox.operators import mutations, relational, tuning, vectors

VEC = "id bigint, person_id bigint, cluster_id bigint, vec array<double>"


def at(degrees):
    return [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]


def apart(degrees):
    return round(1 - math.cos(math.radians(degrees)), 9)


def test_effective_distance_is_the_largest_of_three(spark):
    # person 1 stands at 0, 10 and 40 degrees in cluster 1 and alone at 70 in cluster 2; person 2 at 90 and 120
    rows = [(1, 1, 1, at(0)), (2, 1, 1, at(10)), (3, 1, 1, at(40)), (4, 1, 2, at(70)), (5, 2, 3, at(90)), (6, 2, 3, at(120)), (7, None, 9, at(5))]
    got = {r.id: r for r in tuning.person_distances(spark.createDataFrame(rows, VEC)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    # face 1: the others of its cluster are at 10 and 40; two of them, so the centroid at 25 decides
    assert round(got[1].pos, 9) == apart(25)
    # face 4 is alone in its cluster: the person's other three count, the second nearest at 10 degrees is 60 away
    assert round(got[4].pos, 9) == max(apart(60), round(1 - (lambda x, y: (x * at(70)[0] + y * at(70)[1]) / math.hypot(x, y))(*(sum(at(d)[i] for d in (0, 10, 40)) for i in (0, 1))), 9))
    # person 2 as seen from face 4: nearest 20, centroid at 105 is 35 away
    assert round(got[4].neg, 9) == apart(35)


def test_review_distance_is_the_median_of_supported_faces(spark):
    targets = [(i, 1, at(d)) for i, d in enumerate((1, 2, 3, 80))] + [(9, 2, at(81))]
    refs = [(100, "unknown_person", at(0)), (101, "not_face", at(-90))]
    t = spark.createDataFrame(targets, "id bigint, cluster_id bigint, vec array<double>")
    r = spark.createDataFrame(refs, "id bigint, status string, vec array<double>")
    assert tuning.review_suggestions(t, r, 0.45).count() == 0  # three of four are too few
    got = tuning.review_suggestions(t.where("id <> 3"), r, 0.45).collect()
    assert [(x.cluster_id, x.review_status, x.support_count) for x in got] == [(1, "unknown_person", 3)]
    assert round(got[0].best_distance, 9) == apart(2) and got[0].recommended
    # the newest of the references count, each state up to its own limit
    assert tuning.review_suggestions(t.where("id <> 3"), r, 0.45, newest=1).count() == 0


def test_review_scores_look_at_every_archived_face(spark, tmp_path):
    import duckdb
    from shoebox.plans import registry

    # of 3100 archived faces of one state only the oldest is near the three targets
    turn = lambda sign: [sign if i == 20 else 0.0 for i in range(64)]
    rows = [(11 * i, turn(1.0 if i == 1 else -1.0), 7) for i in range(1, 3101)] + [(11 * i + 2, turn(1.0), 7) for i in (3, 6, 9)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["review_suggestion_scores"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["review_suggestion_scores"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) > 0


def test_nearest_two_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 20)
    df = spark.range(55).select("id", (F.col("id") % 2).alias("g"), F.expr("array(cos(radians(id)), sin(radians(id)))").alias("vec"))
    got = {(r.id, r.g): r for r in vectors.nearest_two(df, df, "g").collect()}
    assert len(got) == 110
    assert round(got[10, 0].nearest, 9) == apart(2) and round(got[10, 0].second, 9) == apart(2) and round(got[10, 1].nearest, 9) == apart(1)
    near = vectors.knn(df, df, 3).where("id = 30").orderBy("rank").collect()
    assert [r.other for r in near] == [29, 31, 28]
    assert vectors.pairs_within(df, apart(1.5)).count() == 54


def test_auto_tune_needs_people(spark):
    rows = [(i, 1 + i % 2, 1 + i % 2, at(90 * (i % 2) + i)) for i in range(12)] + [(50 + i, None, 7, at(200 + i)) for i in range(6)]
    got = tuning.auto_tune(spark.createDataFrame(rows, VEC)).first()
    assert got.same == got.other == 1.0 and got.sampled == 12 and got.stable == 1
    assert 0.85 * got.threshold - 1e-9 <= got.cohesion <= got.threshold and got.outlier >= got.threshold and 0.055 <= got.ambiguity <= 0.18
    with pytest.raises(ValueError):
        tuning.auto_tune(spark.createDataFrame(rows[:1], VEC))


def test_paths_with_apostrophes(spark):
    df = spark.createDataFrame([(1, "/a/b.jpg", True), (1, "/a/Kai's.jpg", True), (2, "/z", True)], "image_id int, path string, exists boolean")
    assert {r.image_id: r.path for r in relational.available_path(df, "/a/Kai's.jpg").collect()} == {1: "/a/Kai's.jpg", 2: "/z"}


def test_names_that_only_lower_alike():
    assert rename_of("x Ka\u0131.jpg", ["Kai"])["proposed_filename"] == "x Ka\u0131 Kai.jpg"
    assert rename_of("DATEI Kai, Ann.jpg", ["Ann"]) is None  # the file ends in the one name that it should
    assert rename_of("DATEI ann & KAI.jpg", ["Kai", "Ann"])["proposed_filename"] == "DATEI Kai, Ann.jpg"


def small_library(spark):
    person = spark.createDataFrame([(1, "Kai")], "id bigint, name string")
    cluster = spark.createDataFrame([(1, None, 1), (2, None, None), (9, None, 1)], "id bigint, label string, person_id bigint")
    rows = [(1, 1, "active"), (2, 1, "not_face"), (3, 2, "active"), (4, 2, "active"), (5, None, "active"), (6, None, "active"), (7, None, "active"), (8, None, "not_face"), (10, 9, "active")]
    face = spark.createDataFrame([(i, 1, c, s) for i, c, s in rows], "id bigint, image_id bigint, cluster_id bigint, review_status string")
    image = spark.createDataFrame([(1,)], "id bigint")
    place = spark.createDataFrame([(1, 1, "/a/b.jpg", "/a", "b.jpg")], "id bigint, image_id bigint, path string, directory string, filename string")
    angles = {1: 0, 2: 0, 3: 40, 4: 42, 5: 41, 6: 100, 7: 102, 8: 100, 10: 3}
    vec = spark.createDataFrame([(i, at(d)) for i, d in angles.items()], "id bigint, vec array<double>")
    return Library(person=person, cluster=cluster, image=image, image_location=place, face=face), vec


def groups(lib):
    return {r.id: r.cluster_id for r in lib.face.collect()}


def test_inbox_is_grouped_with_nobodys_clusters(spark):
    lib, vec = small_library(spark)
    out = mutations.recluster_inbox(mutations.mark_dirty(lib, spark.createDataFrame([(None,), (1,)], "person_id bigint")), vec, 0.05)
    got = groups(out)
    assert got[5] == 2 and got[6] == got[7] and got[6] > 9 and got[8] is None  # archived faces stay loose
    assert [got[i] for i in (1, 2, 3, 4, 10)] == [1, 1, 2, 2, 9]
    assert violations(out).where("rule in ('missing_cluster', 'empty_cluster')").count() == 0
    assert [r.person_id for r in out.recluster_dirty_person.collect()] == [1]


def test_pool_is_rebuilt_without_touching_people(spark):
    lib, vec = small_library(spark)
    got = groups(mutations.rebuild_pool(lib, vec, 0.05))
    assert got[3] == got[4] == got[5] and got[6] == got[7] != got[3] and [got[i] for i in (1, 2, 10)] == [1, 1, 9]


def test_deleted_people_leave_active_loose_faces(spark):
    lib, _ = small_library(spark)
    out = mutations.delete_person(lib, 1)
    states = {r.id: (r.cluster_id, r.review_status) for r in out.face.collect()}
    assert states[1] == states[2] == states[10] == (None, "active") and states[8] == (None, "not_face")
    with pytest.raises(LookupError):
        mutations.delete_person(lib, 77)


def test_suggestion_lists_come_in_order(spark):
    lib, _ = small_library(spark)
    lib = lib.with_tables(cluster_review_suggestion=spark.createDataFrame([(2, "not_face", 0.9, 2, "pending"), (5, "not_face", 0.95, 1, "pending"), (6, "not_face", 1.0, 1, "dismissed")], "cluster_id bigint, review_status string, confidence double, face_count int, status string"))
    got = relational.review_suggestion_list(lib).collect()
    assert [(r.cluster_id, r.recommended, r.preview_face_ids) for r in got] == [(5, True, None), (2, True, [3, 4])]
    assert [r.name for r in relational.person_list(lib).collect()] == ["Kai"]
    page = relational.image_page(lib.with_tables(image_location=lib.image_location.withColumn("created_at", F.current_timestamp()), face=lib.face.withColumn("bbox_x", -F.col("id").cast("double"))))
    assert [r.face_id for r in page.collect()] == [10, 7, 6, 5, 4, 3, 1]
