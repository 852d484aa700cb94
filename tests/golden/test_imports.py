"""Imports: what becomes of proposals, copies, moved and changed files, and replays."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from shoebox.library import Library
from shoebox.operators import imports as I
from shoebox.operators.components import components
from shoebox.storage import numbered
from shoebox.streaming import imports as S

AT = dt.datetime(2024, 5, 1)
FILES = "path string, directory string, filename string, created_at timestamp, file_size bigint, modified_at_ns bigint, content_hash string"
FACES = "content_hash string, place int, bbox_x double, bbox_y double, bbox_w double, bbox_h double, embedding array<float>, proposed bigint"


def file(path, content, size=1, time=1):
    folder, name = path.rsplit("/", 1)
    return (path, folder, name, None, size, time, content)


def face(content, place, proposed):
    return (content, place, 1.0 * place, 0.0, 1.0, 1.0, [1.0], proposed)


@pytest.fixture
def lib(spark):
    make = spark.createDataFrame
    return Library(
        make([(1, "Anna")], "id bigint, name string"),
        make([(7, "Anna", 1), (8, None, None), (9, None, None)], "id bigint, label string, person_id bigint"),
        make([(1, "/a/one.jpg", "/a", "one.jpg", "c1", AT), (2, "/a/two.jpg", "/a", "two.jpg", "c2", AT), (3, "/a/raw.jpg", "/a", "raw.jpg", "c3", None)], "id bigint, path string, directory string, filename string, content_hash string, processed_at timestamp"),
        make([(1, 1, *file("/a/one.jpg", "")[:6]), (2, 2, *file("/a/two.jpg", "")[:6]), (3, 2, *file("/b/two.jpg", "")[:6]), (4, 3, *file("/a/raw.jpg", "")[:6])], "id bigint, image_id bigint, path string, directory string, filename string, created_at timestamp, file_size bigint, modified_at_ns bigint"),
        make([(1, 1, 0.0, 0.0, 1.0, 1.0, 7, "active", [1.0]), (2, 2, 0.0, 0.0, 1.0, 1.0, 8, "active", [1.0]), (3, 1, 2.0, 0.0, 1.0, 1.0, 9, "active", [1.0])], "id bigint, image_id bigint, bbox_x double, bbox_y double, bbox_w double, bbox_h double, cluster_id bigint, review_status string, embedding array<float>"),
    )


def imported(lib, files, faces=()):
    spark = lib.face.sparkSession
    return I.apply_delta(lib, I.import_delta(lib, spark.createDataFrame(list(files), FILES), spark.createDataFrame(list(faces), FACES), AT))


def where(lib):
    return {r.path: r.image_id for r in lib.image_location.collect()}


def test_a_persons_cluster_takes_no_imported_face(lib):
    out = imported(lib, [file("/n/x.jpg", "x"), file("/n/y.jpg", "y")], [face("x", 0, 7), face("x", 1, 7), face("x", 2, 8), face("y", 0, 7), face("y", 1, 40), face("y", 2, None)])
    got = {(r.image_id, r.bbox_x): r.cluster_id for r in out.face.where("id > 3").collect()}
    # one fresh cluster for each image and proposal, after all numbers there are
    assert got == {(4, 0.0): 41, (4, 1.0): 41, (4, 2.0): 8, (5, 0.0): 42, (5, 1.0): 40, (5, 2.0): None}
    clusters = {r.id: (r.label, r.person_id) for r in out.cluster.collect()}
    assert clusters[41] == clusters[42] == ("Neue Gesichtsgruppe", None) and clusters[40] == ("Cluster 40", None) and clusters[7] == ("Anna", 1)
    assert sorted(r.id for r in out.face.collect()) == list(range(1, 10))


def test_unchanged_files_change_nothing(lib):
    out = imported(lib, [file("/a/one.jpg", "other"), file("/a/two.jpg", "c2")], [face("other", 0, 8)])
    assert where(out) == where(lib) and out.face.count() == 3 and out.image.count() == 3


def test_copies_in_one_batch_are_one_image(lib):
    out = imported(lib, [file("/n/b.jpg", "x"), file("/n/a.jpg", "x"), file("/n/a.jpg", "x")], [face("x", 0, 8)])
    assert {p: i for p, i in where(out).items() if p.startswith("/n")} == {"/n/a.jpg": 4, "/n/b.jpg": 4}
    assert out.image.where("id = 4").first().path == "/n/a.jpg" and out.face.count() == 4


def test_a_moved_copy_of_known_content_gets_a_location_alone(lib):
    out = imported(lib, [file("/n/one.jpg", "c1")], [face("c1", 0, 8)])
    assert where(out)["/n/one.jpg"] == 1 and out.face.count() == 3 and out.image.count() == 3


def test_changed_content_leaves_the_old_image(lib):
    out = imported(lib, [file("/a/one.jpg", "new", 2), file("/a/two.jpg", "c1", 2)], [face("new", 0, None)])
    # the old content of /a/one.jpg stays, as /a/two.jpg has it now; that of /a/two.jpg has another path
    assert where(out) == {"/a/one.jpg": 4, "/a/two.jpg": 1, "/b/two.jpg": 2, "/a/raw.jpg": 3}
    assert {r.id: r.path for r in out.image.collect()}[2] == "/b/two.jpg"
    gone = imported(lib, [file("/a/one.jpg", "new", 2)])
    assert {r.id for r in gone.image.collect()} == {2, 3, 4} and {r.id for r in gone.face.collect()} == {2}
    assert {r.id for r in gone.cluster.collect()} == {8}


def test_an_unprocessed_image_is_done_again(lib):
    out = imported(lib, [file("/a/raw.jpg", "c3")], [face("c3", 0, 9)])
    row = out.image.where("id = 3").first()
    assert row.processed_at == AT and out.image.count() == 3 and [(r.image_id, r.cluster_id) for r in out.face.where("id > 3").collect()] == [(3, 9)]
    again = imported(out, [file("/a/raw.jpg", "c3")], [face("c3", 0, 9)])
    assert again.face.count() == out.face.count()


def test_replays_write_nothing_twice(lib, spark):
    path, source = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    detect = lambda df: df.select("content_hash").distinct().select("content_hash", F.lit(0).alias("place"), *(F.lit(0.0).alias(f"bbox_{c}") for c in "xywh"), F.array(F.lit(1.0).cast("float")).alias("embedding"), F.lit(7).cast("bigint").alias("proposed"))
    sink = S.import_sink(lib, path, detect)
    spark.createDataFrame([file("/n/x.jpg", "x"), file("/n/y.jpg", "x")], FILES).coalesce(1).write.mode("append").parquet(source)
    S.run_import(spark.readStream.schema(FILES).parquet(source), sink, f"{path}/checkpoint").awaitTermination(120)
    once = S.library_now(lib, path)
    assert once.face.count() == 4 and where(once)["/n/y.jpg"] == 4
    one = spark.read.schema(FILES).parquet(source)
    sink(one, 0)  # a replay of a batch that counts
    assert S.ledger(spark, path).count() == 1 and S.library_now(lib, path).face.count() == 4
    # a batch that was written but never counted is written over
    two = spark.createDataFrame([file("/n/z.jpg", "z")], FILES)
    for name, rows in I.import_delta(once, two, detect(two), AT).items():
        rows.write.parquet(f"{path}/delta/{name}/batch=1")
    assert S.library_now(lib, path).face.count() == 4
    sink(two, 1)
    now = S.library_now(lib, path)
    assert sorted(r.id for r in now.face.collect()) == [1, 2, 3, 4, 5] and sorted(map(tuple, S.ledger(spark, path).collect())) == [(0, 4, 4, 4, 4), (1, 5, 5, 5, 5)]
    assert {r.cluster_id for r in now.face.where("id > 3").collect()} == {10, 11}


def test_numbers_and_components(spark):
    rows = spark.createDataFrame([(i % 7, i) for i in range(200)], "a int, b int").repartition(6)
    got = sorted((r.a, r.b, r.n) for r in numbered(rows, "a", "b").collect())
    assert [x[2] for x in got] == list(range(200))
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, 100), (200, 150), (150, 200)], "a bigint, b bigint")
    assert dict(map(tuple, components(edges).collect())) == {i: i // 20 * 20 for i in range(1, 60) if i % 20} | {200: 150}
    assert components(edges.where("false")).count() == 0
