"""Old snapshots, foreign libraries, and what is left after a failure."""

import tempfile
from pathlib import Path

import pytest

from shoebox import library as L
from shoebox import migrations
from shoebox.library import Library


def legacy(spark):
    make = spark.createDataFrame
    return {
        "person": make([(1, "Anna")], "id bigint, name string"),
        "cluster": make([(7, "a", 1), (8, None, 99)], "id bigint, label string, person_id bigint"),
        "face": make([(1, "/p/a.jpg", 0.0, 7), (2, "/p/a.jpg", 1.0, 8), (3, r"C:\x\b.jpg", 0.0, 9), (4, "c.jpg", 0.0, None), (5, None, 0.0, 7)], "id bigint, image_path string, bbox_x double, cluster_id bigint"),
    }


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_faces_of_paths_become_todays(spark):
    lib, taken = migrations.migrate(legacy(spark))
    assert taken == ["faces of paths", "locations of images"]
    paths = {r.id: (r.path, r.directory, r.filename) for r in lib.image.collect()}
    assert sorted(paths.values()) == sorted([("/p/a.jpg", "/p", "a.jpg"), (r"C:\x\b.jpg", r"C:\x", "b.jpg"), ("c.jpg", "", "c.jpg")])
    assert {(r.id, paths[r.image_id][2], r.review_status) for r in lib.face.collect()} == {(1, "a.jpg", "active"), (2, "a.jpg", "active"), (3, "b.jpg", "active"), (4, "c.jpg", "active")}
    assert rows(lib.image_location, "path") == sorted([(p[0],) for p in paths.values()], key=str)


def test_steps_are_taken_once(spark):
    once, _ = migrations.migrate(legacy(spark))
    twice, taken = migrations.migrate(once.tables())
    assert taken == []
    for name, df in once.tables().items():
        assert rows(df, *df.columns) == rows(getattr(twice, name), *df.columns)


def test_hashes_merge_copies(spark):
    hashes = spark.createDataFrame([("/p/a.jpg", "h"), ("c.jpg", "h"), ("gone", "x")], "path string, content_hash string")
    lib, _ = migrations.migrate(legacy(spark), hashes)
    assert lib.image.count() == 2 and lib.image_location.count() == 3
    assert len({r.image_id for r in lib.image_location.where("path in ('/p/a.jpg', 'c.jpg')").collect()}) == 1
    old = {"person": legacy(spark)["person"], "cluster": legacy(spark)["cluster"], "image": spark.createDataFrame([(1, "/a", "/", "a"), (2, "/b", "/", "b")], "id bigint, path string, directory string, filename string"), "face": spark.createDataFrame([(1, 2, 7)], "id bigint, image_id bigint, cluster_id bigint")}
    got, taken = migrations.migrate(old)
    assert taken == ["states of faces", "hashes of images", "locations of images"] and rows(got.image_location, "image_id", "path") == [(1, "/a"), (2, "/b")]


@pytest.fixture
def there(spark):
    """A library of one version, and a folder with a foreign one."""
    path, source = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    make = spark.createDataFrame
    old = Library(make([(1, "Old")], "id bigint, name string"), make([(1, None, 1)], "id bigint, label string, person_id bigint"), make([(1, "/o")], "id bigint, path string"), make([(1, 1, "/o")], "id bigint, image_id bigint, path string"), make([(1, 1, 1, "active")], "id bigint, image_id bigint, cluster_id bigint, review_status string"))
    L.write_snapshot(old, path, 1)
    return path, source


def put(tables, source, leave=()):
    for name, df in tables.items():
        if name not in leave:
            df.write.mode("overwrite").parquet(f"{source}/{name}")


def test_a_foreign_library_takes_the_place(spark, there):
    path, source = there
    put(legacy(spark), source)
    assert L.import_foreign(spark, source, path) == 2
    now = L.read_snapshot(spark, path)
    assert now.face.count() == 4 and {r.name for r in now.person.collect()} == {"Anna"} and L.violations(now).count() == 0
    assert L.read_snapshot(spark, path, 1).person.first().name == "Old"


def test_faults_of_the_source_leave_the_old_library(spark, there):
    path, source = there
    put(legacy(spark), source, leave=("person",))
    with pytest.raises(ValueError, match="no table person"):
        L.import_foreign(spark, source, path)
    todays = migrations.migrate(legacy(spark))[0].tables()
    put(todays | {"cluster": todays["cluster"].drop("person_id")}, source)
    with pytest.raises(ValueError, match="no column cluster.person_id"):
        L.import_foreign(spark, source, path)
    put(todays | {"face": todays["face"].unionByName(todays["face"].limit(1))}, source)
    with pytest.raises(ValueError, match="ids of face"):
        L.import_foreign(spark, source, path)
    assert L.current_version(spark, path) == 1 and L.read_snapshot(spark, path).person.first().name == "Old"


def test_a_loss_between_writes_leaves_the_old_library(spark, there, monkeypatch):
    path, source = there
    put(legacy(spark), source)

    def lost(*_):
        raise RuntimeError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(L, "mark_version", lost)
        with pytest.raises(RuntimeError):
            L.import_foreign(spark, source, path)
    assert L.read_snapshot(spark, path).person.first().name == "Old"
    assert L.import_foreign(spark, source, path) == 2  # what was written aside is written over
    assert L.read_snapshot(spark, path).person.first().name == "Anna"


def test_recovery_passes_over_damage_of_any_table(spark, there):
    path, source = there
    put(legacy(spark), source)
    L.import_foreign(spark, source, path)
    for f in Path(f"{path}/v=2/cluster").glob("part-*.parquet"):
        f.write_bytes(f.read_bytes()[:40])
        Path(f"{f.parent}/.{f.name}.crc").unlink(missing_ok=True)
    assert L.recover(spark, path).person.first().name == "Old"
