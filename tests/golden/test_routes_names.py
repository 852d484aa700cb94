"""Routes, crops and names compared without case."""

import unicodedata

from pyspark.sql import functions as F

from shoebox.functions import routes
from shoebox.functions.text import casefolded, name_key
from shoebox.operators import relational as R


def test_routes_are_read_back_and_nonsense_is_left_out(spark):
    views = [("people", None, None, None), ("renaming", 4, "x", "daten"), ("review", 12, None, None), ("review", None, "not_face", None), ("review", 3, "not_face", None), ("settings", 3, None, "updates"), ("settings", None, None, None), ("elsewhere", 1, None, None)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(views)], "n int, page string, cluster_id bigint, group_key string, section string")
    made = df.select("n", routes.route(*(F.col(c) for c in df.columns[1:])).alias("route")).withColumn("v", routes.view_of(F.col("route")))
    got = {r.n: (r.route, tuple(r.v)) for r in made.collect()}
    assert [got[i][0] for i in range(8)] == ["#/bilder", "#/dateinamen", "#/gesichter-pruefen/gruppe/12", "#/gesichter-pruefen/kategorie/not_face", "#/gesichter-pruefen/gruppe/3", "#/einstellungen/updates", "#/einstellungen", None]
    assert got[1][1] == ("renaming", None, None, None) and got[4][1] == ("review", 3, None, None) and got[5][1] == ("settings", None, None, "updates") and got[7][1] == ("people", None, None, None)
    texts = {
        "": ("people", None), "#": ("people", None), "gesichter-pruefen//gruppe/ +7x": ("review", 7), "#/gesichter-pruefen/gruppe/0": ("review", None), "#/gesichter-pruefen/gruppe/-3": ("review", None),
        "#/gesichter-pruefen/gruppe": ("review", None), "#/gesichter-pruefen/gruppe/9007199254740992": ("review", None), "#/gesichter-pruefen/gruppe/9007199254740991/more": ("review", 2**53 - 1),
        "#/gesichter-pruefen/gruppe/99999999999999999999": ("review", None), "#/bilder/gruppe/7": ("people", None), "#/people": ("people", None),
    }
    read = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("v", routes.view_of(F.col("t"))).collect()
    assert {r.t: (r.v.page, r.v.cluster_id) for r in read} == texts


def test_names_meet_without_case(spark):
    letters = [chr(c) for c in range(32, 0x2000) if unicodedata.category(chr(c)) not in ("Cn", "Cs") and not 0x13A0 <= c <= 0x13FF]
    rows = spark.createDataFrame([(x,) for x in [*letters, "Straße", "ΟΔΥΣΣΕΥΣ", "Iıİ"]], "x string").select("x", casefolded(F.col("x")).alias("got")).collect()
    # letters newer than the JVM's tables, and those whose capital is made of several, are all that differ
    differ = [r.x for r in rows if r.got != r.x.casefold()]
    assert len(differ) <= 12 and not any(ord(x) < 0x250 for x in differ), differ
    keys = spark.createDataFrame([("\u2003Straße\t",), ("STRASSE",), (" strasse ",)], "name string").select(name_key(F.col("name")).alias("k")).distinct().collect()
    assert [r.k for r in keys] == ["strasse"]


def test_crops_take_the_first_location_there_is(spark):
    faces = spark.createDataFrame([(1, 10, 3.9, -2.7, 5.0, float("nan")), (2, 10, None, 1.0, float("inf"), 2.5), (3, 11, 1.0, 1.0, 1.0, 1.0), (4, 12, 1.0, 1.0, 1.0, 1.0)], "id bigint, image_id bigint, bbox_x double, bbox_y double, bbox_w double, bbox_h double")
    places = spark.createDataFrame([(10, "/b", True), (10, "/a", False), (10, "/c", True), (11, "/d", False)], "image_id bigint, path string, exists boolean")
    assert sorted(map(tuple, R.face_crops(faces, places).collect())) == [(1, "/b", 3, -2, 5, 0), (2, "/b", 0, 1, 0, 2)]
    wanted = spark.createDataFrame([(2,), (2,), (3,), (99,)], "id bigint")
    assert list(map(tuple, R.face_crops(faces, places, wanted).collect())) == [(2, "/b", 0, 1, 0, 2)]
    assert R.face_crops(faces.where("false"), places).count() == 0
