"""Golden cases of the library: grouping on angles, names, jobs, repairs, streams."""

import math
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shoebox.functions import text as X
from shoebox.library import Library, read_snapshot, violations, write_snapshot
from shoebox.operators import clustering as C
from shoebox.operators import jobs, mutations
from shoebox.operators import relational as R
from shoebox.schemas import clustering_profile


def at(degrees):
    return [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]


def grouped(labels):
    seen = {}
    return [seen.setdefault(x, len(seen)) for x in labels]


def run(angles, t):
    work = C.Assigner(t)
    return grouped([work.add(np.array(at(a))) for a in angles])


def test_chains_and_compact_groups():
    assert run([0, 30, 60, 90], 0.15) == [0, 0, 1, 1]
    assert run([0, 4, 8, 12, 16], 0.05) == [0] * 5
    work = C.Assigner(0.15)
    work.load(np.array([at(0), at(30), at(60)]), [7, 7, 7])
    assert work.add(np.array(at(90))) != 7


@pytest.mark.parametrize(("angle", "t", "persons", "want"), [(33, 0.3, True, 11), (65, 0.5, True, 31), (178, 0.1, True, 30), (3, 0.3, False, 31)])
def test_people_in_the_way(angle, t, persons, want):
    work = C.Assigner(t, persons)
    work.load(np.array([at(a) for a in (0, 5, 10, 30, 35, 40, 90, 95, 100, 180)]), [10] * 3 + [11] * 3 + [20] * 3 + [30], [1] * 6 + [2] * 3 + [-1])
    assert work.add(np.array(at(angle))) == want


def test_split_and_path():
    two = C.split_labels(np.array([at(a) for a in (0, 10, 20, 70, 80, 90)]), 0.15)
    assert list(two) == [0, 0, 0, 1, 1, 1]
    assert not C.split_labels(np.array([at(a) for a in (0, 5, 10, 15, 20)]), 0.15).any()
    angles, ids = [175, 5, 180, 0, 170, 10], np.array([60, 10, 50, 20, 40, 30])
    walk = [angles[i] > 90 for i in C.path_order(np.array([at(a) for a in angles]), ids)]
    assert sum(a != b for a, b in zip(walk, walk[1:])) == 1
    with pytest.raises(ValueError):
        C.path_order(np.zeros(3), ids)


@pytest.mark.parametrize(("angles", "labels", "movable", "t", "want"), [
    ([0, 5, 10, 18], [1, 1, 1, 2], True, 0.02, [1, 1, 1, 1]),
    ([0, 5, 10, 18, 80], [1, 1, 1, 2, 2], True, 0.02, [1, 1, 1, 2, 2]),
    ([0, 4, 8, 32, 36, 40, 20], [1, 1, 1, 2, 2, 2, 3], True, 0.08, [1, 1, 1, 2, 2, 2, 3]),
    ([0, 5, 10, 18], [1, 1, 1, 2], False, 0.02, [1, 1, 1, 2]),
])
def test_consolidate(spark, angles, labels, movable, t, want):
    faces = spark.createDataFrame([(i, c, at(a), movable) for i, (a, c) in enumerate(zip(angles, labels))], "id bigint, cluster_id bigint, vec array<double>, movable boolean")
    got = dict(map(tuple, C.consolidate(faces, t).collect()))
    assert [got[i] for i in range(len(want))] == want


def test_regroup_keeps_people_apart(spark):
    rows = [(i, p, at(a)) for i, (p, a) in enumerate([(1, 0), (1, 30), (1, 60), (1, 90), (2, 170), (2, 175), (None, 120)])]
    got = {r.id: (r.person_id, r.cluster_id) for r in C.regroup(spark.createDataFrame(rows, "id bigint, person_id bigint, vec array<double>"), 0.15).collect()}
    assert [got[i][0] for i in range(7)] == [1, 1, 1, 1, 2, 2, None]
    assert grouped([got[i][1] for i in range(7)]) == [0, 0, 1, 1, 2, 2, 3]


@pytest.mark.parametrize(("name", "suffix", "proposed"), [
    ("Test (1) Kai.jpg", ["Kai"], "Test (1) Kai, Regina.jpg"),
    ("Kai's Geburtstag.jpg", [], "Kai's Geburtstag Kai, Regina.jpg"),
    ("Kai's Geburtstag Regina, Kai.jpg", ["Regina", "Kai"], "Kai's Geburtstag Kai, Regina.jpg"),
    ("Kai's Geburtstag Regina.jpg", ["Regina"], "Kai's Geburtstag Kai, Regina.jpg"),
    ("Kai's Geburtstag Kai   Regina.jpg", ["Kai", "Regina"], "Kai's Geburtstag Kai, Regina.jpg"),
    ("Kai's Geburtstag Kai,Regina.jpg", ["Kai", "Regina"], "Kai's Geburtstag Kai, Regina.jpg"),
    ("Test (1).jpg", [], "Test (1) Kai, Regina.jpg"),
])
def test_rename(name, suffix, proposed):
    found = X.rename_of(name, ["Kai", "Regina", "kai "])
    assert (found["current_suffix_person_names"], found["proposed_filename"]) == (suffix, proposed)
    assert X.rename_of(proposed, ["Kai", "Regina"]) is None and X.rename_of(name, [" "]) is None


def test_paths_and_versions(spark):
    row = spark.range(1).select(
        X.to_unix_path(F.lit(r"\\?\C:\a\b")).alias("u"), X.to_display_path(F.lit("/mnt/c/a/b")).alias("d"), X.filename_of(F.lit(r"c:\x\y.jpg")).alias("f"),
        (X.semver(F.lit("1.10.0")) > X.semver(F.lit("v1.9.9"))).alias("v"), X.semver(F.lit("x")).alias("none"), X.colour_slot(F.lit("")).alias("c"),
        X.seconds_between(F.lit("2024-01-01T00:00:05"), F.lit("2024-01-01T00:00:01")).alias("s"), X.seconds_between(F.lit("bad"), F.lit("2024-01-01")).alias("b"),
    ).first()
    assert tuple(row) == ("/mnt/c/a/b", r"C:\a\b", "y.jpg", True, None, 0, 0.0, None)


def test_jobs(spark):
    queue = spark.createDataFrame([("q", i, i, s) for i, s in enumerate([120.0, 90.0, 60.0])], "queue string, id bigint, place int, seconds double")
    assert sorted((r.id, r.eta) for r in jobs.makespan(queue, 2).collect()) == [(0, 120.0), (1, 90.0), (2, 150.0)]
    steady = pd.DataFrame({"at": [0, 1, 2, 3, 4, 5, 105], "progress": [0, 1, 2, 3, 4, 5, 6]})
    assert jobs.live_rate(steady) == 1.0
    shown = jobs.eased(pd.DataFrame({"at": [0.0, 10.0, 20.0], "seconds": [100.0, 90.0, 300.0]}))
    assert shown[:2] == [100.0, 90.0] and 80 < shown[2] < 120
    assert clustering_profile(0.5, {"cluster_support_ratio": "bad", "cluster_outlier_threshold": "0.7"})["cluster_outlier_threshold"] == 0.7


@pytest.fixture
def lib(spark):
    person = spark.createDataFrame([(1, "Kai"), (2, "kai "), (3, "Anna")], "id bigint, name string")
    cluster = spark.createDataFrame([(1, "empty", None), (2, None, 99), (5, "x", 1), (6, "y", 2)], "id bigint, label string, person_id bigint")
    image = spark.createDataFrame([(1, "h", 5), (2, "h", 1), (3, None, 2)], "id bigint, content_hash string, processed_at int")
    places = spark.createDataFrame([(1, 1, "/p/a.jpg", "/p", "a.jpg"), (2, 2, "/p/q/b.jpg", "/p/q", "b.jpg"), (3, 3, "/p/q/c.jpg", "/p/q", "c.jpg"), (4, 3, "/z/c.jpg", "/z", "c.jpg")], "id bigint, image_id bigint, path string, directory string, filename string").withColumn("created_at", F.lit(None).cast("timestamp"))
    face = spark.createDataFrame([(1, 1, 0.0, 5, "active"), (2, 1, 1.0, 6, "active"), (3, 3, 0.0, 7, "active"), (4, 3, 1.0, 2, "active"), (5, 3, 2.0, None, "active"), (6, 3, 3.0, 0, "odd")], "id bigint, image_id bigint, bbox_x double, cluster_id bigint, review_status string")
    return Library(person, cluster, image, places, face)


def test_repair_and_people(lib):
    fixed = mutations.repair(lib)
    assert {(r.id, r.person_id) for r in fixed.cluster.collect()} == {(2, None), (5, 1), (6, 2), (7, None), (8, None)}
    assert sorted(map(str, mutations.repair(fixed).cluster.collect())) == sorted(map(str, fixed.cluster.collect()))
    merged = mutations.merge_people(fixed)
    assert {(r.id, r.name) for r in merged.person.collect()} == {(1, "Kai"), (3, "Anna")}
    assert violations(merged).where("rule not in ('hash_repeated')").count() == 0
    assert {r.image_id for r in R.images_of_persons(merged, ["kAi"]).collect()} == {1}


def test_assignments(lib):
    lib = mutations.merge_people(mutations.repair(lib))
    whole = mutations.assign_faces(lib, [3], "Zoe")
    assert whole.cluster.where("id = 7").first().person_id == 4
    split = mutations.archive_faces(lib, [1, 3, 5], "not_face")
    left = {r.id: (r.cluster_id, r.review_status) for r in split.face.collect()}
    assert left[1] == (5, "not_face") and left[5][0] not in (None, 5, 7) and left[4] == (2, "active")
    assert split.cluster.where("id = 5").first().person_id is None and violations(split).where("rule not in ('hash_repeated')").count() == 0
    claimed = mutations.claim_faces(lib, lib.face.sparkSession.createDataFrame([(5, 50), (1, 50)], "id bigint, cluster_id bigint"))
    assert {r.id for r in claimed.face.where("cluster_id = 50").collect()} == {5}
    with pytest.raises(LookupError):
        mutations.assign_cluster(lib, 404, "Kai")
    with pytest.raises(ValueError):
        mutations.checked_ids([0, -1])


def test_paths_images_and_snapshots(lib, spark):
    lib = mutations.repair(lib)
    fewer, lost = mutations.remove_missing_paths(lib, spark.createDataFrame([("/p/a.jpg",), ("/p/q/c.jpg",)], "path string"))
    assert {(r.id, r.path) for r in fewer.image.collect()} == {(2, "/p/q/b.jpg"), (3, "/z/c.jpg")} and {r.id for r in lost.collect()} == {1, 2}
    one = mutations.merge_duplicate_images(lib)
    assert {r.id for r in one.image.collect()} == {1, 3} and one.image_location.where("image_id = 1").count() == 2
    tree = {r.path: (r.direct_image_count, r.image_count) for r in R.folder_tree(lib).collect()}
    assert tree == {"/": (0, 3), "/p": (1, 3), "/p/q": (2, 2), "/z": (1, 1)}
    path = tempfile.mkdtemp(prefix="spark-")
    write_snapshot(lib, path, 1)
    write_snapshot(fewer, path, 2)
    assert read_snapshot(spark, path).image.count() == 2 and read_snapshot(spark, path, 1).image.count() == 3


def test_folder_names_are_not_patterns(spark):
    df = spark.createDataFrame([(r"C:\Family Photos\100%_Best\x",), (r"C:\Family Photos\1000_Best",)], "directory string")
    assert df.where(R.in_folders(F.col("directory"), [r"C:\Family Photos\100%_Best"])).count() == 1


def test_streams(spark):
    from shoebox.streaming import live

    sf = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(sf)
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/event[s].parquet")
    shaped = lambda df: live.timed(df).select("ts", F.col("event_type").alias("topic"), F.col("event_id").alias("payload"))
    q = live.latest_per_topic(shaped(stream)).writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = events.groupBy(F.col("event_type").alias("topic")).agg(F.max_by("event_id", "ts").alias("payload"))
    assert sorted((r.topic, r.payload) for r in spark.table("latest").collect()) == sorted(map(tuple, batch.collect()))
    faces = spark.createDataFrame([(0, i, at(a)) for i, a in enumerate([0, 30, 60, 90])], "pool bigint, id bigint, vec array<double>")
    path = tempfile.mkdtemp(prefix="spark-")
    faces.coalesce(1).write.mode("append").parquet(path)
    q = live.online_groups(spark.readStream.schema(faces.schema).parquet(path), 0.15).writeStream.outputMode("append").format("memory").queryName("groups").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert grouped([r.cluster_id for r in spark.table("groups").orderBy("id").collect()]) == [0, 0, 1, 1]


def test_changelog(spark):
    from shoebox.sources import files

    lines = ["# Log", "## [1.2.0] - 2024-05-01", "### Added", "- one", "- two", "### Fixed", "- three", "## 1.1.0", "### Added", "- four"]
    items = files.parse_changelog(spark.createDataFrame(list(enumerate(lines)), "n int, value string"))
    assert [(r.version, r.section, r.item) for r in items.orderBy("n").collect()] == [("1.2.0", "Added", "one"), ("1.2.0", "Added", "two"), ("1.2.0", "Fixed", "three"), ("1.1.0", "Added", "four")]
    assert {r.version for r in files.releases_between(items, "1.1.0", "1.2.0").collect()} == {"1.2.0"}
    assert dict(map(tuple, files.render_changelog(items).collect()))["1.2.0"].startswith("### Added\n\n- one\n- two\n\n### Fixed")
