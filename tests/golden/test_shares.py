"""What a task holds doesn't grow with the tables."""

from shoebox import adapters
from shoebox.library import Library
from shoebox.operators import relational

SF = "/root/testdata/sf0.001"


def test_views_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(adapters, "TASK_ROWS", 500)
    lib = adapters.library(spark, SF)
    for view in (lib.face, lib.image_location):
        assert view.rdd.getNumPartitions() == 12
    one = {r.id: r.image_id for r in lib.face.select("id", "image_id").collect()}
    monkeypatch.setattr(adapters, "TASK_ROWS", 1_000_000)
    assert one == {r.id: r.image_id for r in adapters.library(spark, SF).face.select("id", "image_id").collect()}


def test_folders_are_counted_without_a_group_for_each_image_and_folder(spark):
    rows = [(1, "/a/b"), (1, "/a/b"), (1, "/a"), (2, "/a/c"), (3, "/"), (3, None), (4, "/a")]
    places = spark.createDataFrame(rows, "image_id bigint, directory string")
    image = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, None)], "id bigint, processed_at int")
    lib = Library(person=None, cluster=None, image=image, image_location=places, face=None)
    tree = relational.folder_tree(lib)
    assert {(r.path, r.direct_image_count, r.image_count) for r in tree.collect()} == {("/", 1, 3), ("/a", 1, 2), ("/a/b", 1, 1), ("/a/c", 1, 1)}
    plan = tree._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate [path" in line and "image_id" in line.split("]")[0] for line in plan.splitlines())
