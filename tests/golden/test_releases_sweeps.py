"""Release payloads, digests, sections of archived faces, the start of the cluster page, and sweeps."""

import hashlib
import json
import tempfile

import pytest
from pyspark.sql import functions as F

from shoebox.library import Library
from shoebox.operators import relational as R
from shoebox.operators import sweeps
from shoebox.sources import releases


def payload(tag="v1.10.0", variants=("", "-GPU"), sums=True, **more):
    version = tag.lstrip("v")
    names = [f"Shoebox-Setup{v}-{version}.exe" for v in variants]
    assets = [{"name": n, "browser_download_url": f"u/{n}", "digest": "sha256:" + "a" * 64} for n in names] + [{"name": f"{n}.sha256", "browser_download_url": f"u/{n}.sha256"} for n in names if sums]
    return json.dumps({"tag_name": tag, "assets": assets, "published_at": "2024"} | more)


def test_release_payloads(spark):
    rows = [(1, payload()), (2, payload(draft=True)), (3, payload("latest")), (4, payload(variants=("",))), (5, payload(sums=False)), (6, "{not json"), (7, None), (8, "{}"), (9, payload("v1.9.0", assets=None)), (10, payload("1.2.0"))]
    df = spark.createDataFrame(rows, "id int, payload string")
    got = {r.id: r for r in releases.release_candidates(df, "1.9.0", "Shoebox-Setup", "gpu").collect()}
    assert {i: r.problem for i, r in got.items()} == {1: None, 2: "unreleased", 3: "version", 4: "no installer", 5: "no installer", 6: "unreadable", 7: "unreadable", 8: "version", 9: "no installer", 10: None}
    assert (got[1].version, got[1].installer_name, got[1].update_available) == ("1.10.0", "Shoebox-Setup-GPU-1.10.0.exe", True)
    assert (got[9].update_available, got[10].update_available, got[3].version) == (False, False, None)
    assert releases.release_candidates(df, "1.9.0", "Shoebox-Setup").where("id = 4").first().installer_url == "u/Shoebox-Setup-1.10.0.exe"


def test_digests(spark):
    sha = hashlib.sha256(b"x").hexdigest()
    files = spark.createDataFrame([(n, bytearray(b"x")) for n in ("good", "upper", "bad", "none", "other", "odd", "apart")], "name string, content binary")
    lists = [("good", f"{sha}  good", None), ("upper", f"{sha.upper()} *upper", f"sha256:{sha}"), ("bad", f"{'0' * 64}  bad", ""), ("other", f"{sha}  elsewhere", ""), ("odd", "1234  odd", ""), ("apart", f"{sha}  apart", "sha256:" + "1" * 64)]
    got = {r.name: r.problem for r in releases.verified(files, spark.createDataFrame(lists, "name string, text string, digest string")).collect()}
    assert got == {"good": None, "upper": None, "bad": "wrong checksum", "none": "unpublished", "other": "invalid checksum", "odd": "invalid checksum", "apart": "contradiction"}


def test_release_texts(spark):
    body = "- lost\n## Neu\n- one\r\n-two\n  - three \n## Leer\n## Behoben\n- four"
    got = releases.release_sections(spark.createDataFrame([(1, body), (2, None)], "id int, body string")).orderBy("place").collect()
    assert [(r.title, r.item) for r in got] == [("Neu", "one"), ("Neu", "three"), ("Behoben", "four")]


@pytest.fixture
def lib(spark):
    make = spark.createDataFrame
    faces = [(1, 10, 5, "not_face"), (2, 10, 6, "not_face"), (3, 11, 6, "not_face"), (4, 11, None, "not_face"), (5, 12, 7, "not_face"), (6, 12, 6, "active"), (7, 13, 9, "active"), (8, 13, 9, "active"), (9, 14, 6, "active"), (10, 14, 9, "active")]
    face = make([(*f, [1.0, 0.1 * f[0]] if f[0] != 7 else None) for f in faces], "id bigint, image_id bigint, cluster_id bigint, review_status string, vec array<double>")
    places = make([(i, i, f"/p/{i}", "/p", f"{i}") for i in range(10, 15)], "id bigint, image_id bigint, path string, directory string, filename string")
    return Library(make([(1, "Zoe"), (2, "anna")], "id bigint, name string"), make([(5, "five", None), (6, " six ", 1), (7, None, None), (9, None, 2)], "id bigint, label string, person_id bigint"), make([(i,) for i in range(10, 15)], "id bigint"), places, face)


def test_archive_sections(lib):
    got = R.archive_sections(lib, "not_face").orderBy("place").collect()
    # cluster 5 has a label, but no active face that shows it
    assert [tuple(r) for r in got] == [(0, "cluster-6", "six", 6, 2), (1, "cluster-5", "Gruppe 5", 5, 1), (2, "cluster-7", "Gruppe 7", 7, 1), (3, "ungrouped", "Einzelne Gesichter", None, 1)]
    assert sorted((r.place, r.face_id) for r in R.archive_section_faces(lib, "not_face").collect()) == [(0, 2), (0, 3), (1, 1), (2, 5), (3, 4)]


def test_picker(lib):
    names = lambda **k: [(r.name, r.selected) for r in R.person_picker(lib, **k).collect()]
    assert names() == [("anna", False), ("Zoe", False)]
    assert names(selected=["Zoe", "Gone"], collapsed=1) == [("Gone", True), ("Zoe", True)]
    assert names(search=" ZO ", collapsed=0) == [("Zoe", False)]


def test_overview(lib):
    got = R.overview(lib).collect()
    of = lambda part: [tuple(r)[2:] for r in sorted(got, key=lambda r: r.place) if r.part == part]
    assert of("cluster") == [(9, None, "anna", 3), (6, " six ", "Zoe", 2)]
    assert [(r[1], r[3]) for r in of("group")] == [("Nicht zugewiesen", 0), ("Unbekannte Personen", 0), ("Keine Gesichter", 5)]
    assert [r[0] for r in of("face")][-1] == 7 and {r[0] for r in of("face")} == {7, 8, 10}


def test_sweeps_stop_where_nothing_changed(spark):
    rows, path = spark.range(1, 26).withColumn("v", F.lit("a")), tempfile.mkdtemp(prefix="spark-") + "/state"
    seen, missing = [], {3, 24}

    def work(df):
        ids = {r.id for r in df.collect()}
        seen.append(len(ids))
        made = len(missing & ids)
        missing.difference_update(ids)
        return made

    steps = [sweeps.sweep(rows, path, work, 10) for _ in range(7)]
    # the first round made something, so a second one looks again; then it is warm
    assert [s[0] for s in steps] == ["running", "running", "ended", "running", "running", "ended", "idle"] and sum(seen) == 50
    assert sweeps.sweep(rows.repartition(3), path, work, 10) == ("idle", 0)
    changed = rows.withColumn("v", F.when(F.col("id") == 9, "b").otherwise("a"))
    assert sweeps.sweep(changed, path, work, 10) == ("running", 10)
    assert sweeps.sweep(spark.range(0), tempfile.mkdtemp(prefix="spark-") + "/state", work, 10) == ("ended", 0)
