"""Registered queries of what changes a library: imports, reclustering, edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoebox import migrations
from shoebox.adapters import library, tables
from shoebox.library import Library
from shoebox.operators import imports, mutations, reclustering
from shoebox.plans.registry import register, sql_of

_PROPOSED = "proposals AS (SELECT id, image_id, CASE WHEN id % 9 = 0 THEN cluster_id + 1000000 ELSE cluster_id END AS proposed FROM face)"


@register("import_clusters", sql_of("SELECT p.id, coalesce(f, proposed) AS cluster_id FROM proposals p LEFT JOIN fresh USING (image_id, proposed)", _PROPOSED,
    "top AS (SELECT greatest((SELECT max(id) FROM cluster), (SELECT max(proposed) FROM proposals), (SELECT max(cluster_id) FROM face)) + 1 AS t)",
    "owned AS (SELECT DISTINCT image_id, proposed FROM proposals JOIN cluster c ON c.id = proposed WHERE c.person_id IS NOT NULL)",
    "fresh AS (SELECT image_id, proposed, row_number() OVER (ORDER BY image_id, proposed) - 1 + t AS f FROM owned, top)"))
def import_clusters(spark, sf_dir):
    lib = library(spark, sf_dir)
    proposals = lib.face.select("id", "image_id", F.expr("if(id % 9 = 0, cluster_id + 1000000, cluster_id)").alias("proposed"))
    return imports.resolve_clusters(lib, proposals)[0].select("id", "cluster_id")


def _documents_as_files(spark, sf_dir):
    """A library of the documents whose doc_id 3 divides, and all documents as files that are imported into it."""
    docs = tables(spark, sf_dir, "documents")["documents"].select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("content_hash"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("file_size"))
    path = F.concat(F.lit("/in/"), F.col("doc_id"))
    named = docs.select("doc_id", path.alias("path"), F.lit("/in").alias("directory"), F.col("doc_id").cast("string").alias("filename"), F.lit(None).cast("timestamp").alias("created_at"), "file_size", (F.col("doc_id") % 5).alias("modified_at_ns"), "content_hash")
    old = named.where("doc_id % 3 = 0")
    image = old.groupBy("content_hash").agg((F.min("doc_id") + 1).alias("id"), F.min("path").alias("path"), F.lit("/in").alias("directory"), F.min_by("filename", "path").alias("filename"))
    image = image.withColumn("processed_at", F.expr("if(id % 5 > 0, timestamp'2024-01-01', null)"))
    place = old.join(image.select("content_hash", F.col("id").alias("image_id")), "content_hash").withColumn("file_size", F.expr("file_size + doc_id % 2"))
    face = image.select("id", F.col("id").alias("image_id"), *(F.lit(0.0).alias(f"bbox_{c}") for c in "xywh"), F.lit(1).cast("bigint").alias("cluster_id"), F.lit("active").alias("review_status"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    cluster = spark.range(1, 3).select("id", F.lit(None).cast("string").alias("label"), F.expr("if(id = 1, 1L, null)").alias("person_id"))
    person = spark.range(1, 2).select("id", F.lit("Anna").alias("name"))
    lib = Library(person, cluster, image, place.withColumn("id", F.col("doc_id")).drop("doc_id", "content_hash"), face)
    faces = named.groupBy("content_hash").agg(F.min("doc_id").alias("d")).select("content_hash", F.explode(F.array(F.lit(0), F.lit(1))).alias("place"), *(F.lit(0.0).alias(f"bbox_{c}") for c in "xywh"), F.array(F.lit(1.0).cast("float")).alias("embedding"), (F.col("d") % 2 + 1).alias("proposed"))
    return imports.apply_delta(lib, imports.import_delta(lib, named.drop("doc_id"), faces, F.lit("2024-06-01").cast("timestamp")))


_FILES = """files AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents), lib AS (SELECT h, min(doc_id) + 1 AS id FROM files WHERE doc_id % 3 = 0 GROUP BY h),
 new AS (SELECT h, row_number() OVER (ORDER BY h) - 1 + (SELECT max(id) + 1 FROM lib) AS id FROM (SELECT DISTINCT h FROM files WHERE h NOT IN (SELECT h FROM lib))), every AS (SELECT h, coalesce(lib.id, new.id) AS id, lib.id IS NULL OR lib.id % 5 = 0 AS work FROM lib FULL JOIN new USING (h))"""


@register("imported_locations", f"WITH {_FILES} SELECT '/in/' || doc_id AS path, id AS image_id FROM files JOIN every USING (h)")
def imported_locations(spark, sf_dir):
    return _documents_as_files(spark, sf_dir).image_location.select("path", "image_id")


@register("imported_faces", f"""WITH {_FILES}, work AS (SELECT every.id AS image_id, d % 2 + 1 AS proposed FROM every JOIN (SELECT h, min(doc_id) AS d FROM files GROUP BY h) USING (h) WHERE work),
 owned AS (SELECT image_id, row_number() OVER (ORDER BY image_id) + 2 AS c FROM work WHERE proposed = 1), old AS (SELECT max(id) AS m FROM lib)
 SELECT m + row_number() OVER (ORDER BY image_id, place) AS id, image_id, coalesce(c, proposed) AS cluster_id FROM work LEFT JOIN owned USING (image_id), range(2) AS r(place), old
 UNION ALL SELECT id, id, 1 FROM lib WHERE id % 5 > 0""")
def imported_faces(spark, sf_dir):
    return _documents_as_files(spark, sf_dir).face.select("id", "image_id", "cluster_id")


_BUNCHES = """SELECT vec_id + 1 AS id, key, CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 5 = 0 THEN 1000 + key WHEN vec_id % 5 = 1 AND key % 2 = 0 THEN 2000 + key END AS cluster_id, CASE WHEN vec_id % 11 = 0 THEN 'not_face' ELSE 'active' END AS status
  FROM (SELECT vec_id, CAST(label * 3 + vec_id % 3 AS BIGINT) AS key FROM embeddings) AS bunches"""


@register("recluster_claims", f"""WITH f AS ({_BUNCHES}), loose AS (SELECT * FROM f WHERE status = 'active' AND cluster_id IS NULL), known AS (SELECT DISTINCT key FROM f WHERE cluster_id >= 2000),
 fresh AS (SELECT key, row_number() OVER (ORDER BY min(id)) + (SELECT max(cluster_id) FROM f) AS c FROM loose WHERE key NOT IN (SELECT key FROM known) GROUP BY key) SELECT id, coalesce(c, 2000 + key) AS cluster_id FROM loose LEFT JOIN fresh USING (key)""")
def recluster_claims(spark, sf_dir):
    f = spark.sql(_BUNCHES.replace("FROM embeddings", "FROM {embeddings}"), **tables(spark, sf_dir, "embeddings"))
    face = f.select("id", F.col("id").alias("image_id"), F.col("cluster_id").cast("bigint").alias("cluster_id"), F.col("status").alias("review_status"))
    cluster = face.where("cluster_id is not null").select(F.col("cluster_id").alias("id")).distinct().select("id", F.lit(None).cast("string").alias("label"), F.expr("if(id < 2000, 1L, null)").alias("person_id"))
    person = spark.range(1, 2).select("id", F.lit("Anna").alias("name"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: (i == F.col("key")).cast("double"))
    lib = Library(person, cluster, face.select(F.col("image_id").alias("id")), face.select("image_id"), face)
    return reclustering.recluster(lib, f.select("id", vec.alias("vec")), 0.3)[1]


_CHOSEN = "chosen AS (SELECT id FROM face WHERE id % 6 = 0)"


@register("archived_faces", sql_of("""SELECT f.id, CASE WHEN f.id % 6 > 0 THEN f.cluster_id WHEN n = total AND f.cluster_id IS NOT NULL THEN f.cluster_id ELSE fresh END AS cluster_id, CASE WHEN f.id % 6 = 0 THEN 'not_face' ELSE f.review_status END AS review_status
  FROM face f LEFT JOIN parts p ON p.cluster_id IS NOT DISTINCT FROM f.cluster_id""", _CHOSEN,
    "counted AS (SELECT cluster_id, count(*) FILTER (id % 6 = 0) AS n, count(*) AS total FROM face GROUP BY cluster_id HAVING n > 0)",
    "parts AS (SELECT *, CASE WHEN cluster_id IS NULL OR n < total THEN row_number() OVER (PARTITION BY cluster_id IS NULL OR n < total ORDER BY cluster_id NULLS FIRST) + greatest((SELECT max(id) FROM cluster), (SELECT max(cluster_id) FROM face)) END AS fresh FROM counted)"))
def archived_faces(spark, sf_dir):
    lib = library(spark, sf_dir)
    return mutations.archive_faces(lib, lib.face.where("id % 6 = 0").select("id"), "not_face").face.select("id", "cluster_id", "review_status")


@register("restored_faces", sql_of("SELECT id, CASE WHEN id % 6 = 0 THEN NULL ELSE cluster_id END AS cluster_id, CASE WHEN id % 6 = 0 THEN 'active' ELSE review_status END AS review_status FROM face"))
def restored_faces(spark, sf_dir):
    lib = library(spark, sf_dir)
    return mutations.restore_faces(lib, lib.face.where("id % 6 = 0").select("id")).face.select("id", "cluster_id", "review_status")


@register("dirty_after_edits", sql_of("SELECT DISTINCT c.person_id FROM face f JOIN cluster c ON c.id = f.cluster_id WHERE f.id % 6 = 0 AND c.person_id IS NOT NULL"))
def dirty_after_edits(spark, sf_dir):
    lib = library(spark, sf_dir)
    return mutations.archive_faces(lib, lib.face.where("id % 6 = 0").select("id"), "not_face").recluster_dirty_person


@register("accepted_reviews", sql_of("SELECT f.id, CASE WHEN hit THEN NULL ELSE f.cluster_id END AS cluster_id, CASE WHEN hit THEN 'unknown_person' ELSE f.review_status END AS review_status FROM (SELECT *, coalesce(cluster_id % 4 = 0 AND review_status = 'active', false) AS hit FROM face) f"))
def accepted_reviews(spark, sf_dir):
    lib = library(spark, sf_dir)
    pending = lib.cluster.select(F.col("id").alias("cluster_id"), F.lit("unknown_person").alias("review_status"), F.lit("pending").alias("status"))
    out = mutations.accept_review_suggestions(lib.with_tables(cluster_review_suggestion=pending), lib.cluster.where("id % 4 = 0").select(F.col("id").alias("cluster_id")))
    return out.face.select("id", "cluster_id", "review_status")


@register("merged_people", "SELECT c_custkey AS id, min(p.s_suppkey) OVER (PARTITION BY p.s_nationkey) AS person_id FROM customer JOIN supplier p ON p.s_suppkey = c_custkey")
def merged_people(spark, sf_dir):
    t = tables(spark, sf_dir, "supplier", "customer")
    person = t["supplier"].select(F.col("s_suppkey").alias("id"), F.expr("concat(if(s_suppkey % 2 = 0, 'N', 'n'), s_nationkey)").alias("name"))
    cluster = t["customer"].select(F.col("c_custkey").alias("id"), F.lit(None).cast("string").alias("label"), F.col("c_custkey").alias("person_id"))
    lib = library(spark, sf_dir).with_tables(person=person, cluster=cluster.join(person.select(F.col("id").alias("person_id")), "person_id", "left_semi").select("id", "label", "person_id"))
    return mutations.merge_people(lib).cluster.select("id", "person_id")


@register("merged_images", "SELECT doc_id AS location_id, first_value(doc_id) OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id % 4 = 0, doc_id) AS image_id FROM documents")
def merged_images(spark, sf_dir):
    docs = tables(spark, sf_dir, "documents")["documents"].select(F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("content_hash"))
    image = docs.withColumn("processed_at", F.expr("if(id % 4 = 0, null, 1)"))
    lib = library(spark, sf_dir).with_tables(image=image, image_location=docs.select("id", F.col("id").alias("image_id"), F.col("id").cast("string").alias("path")))
    return mutations.merge_duplicate_images(lib).image_location.select(F.col("id").alias("location_id"), "image_id")


@register("deleted_image", sql_of("SELECT id FROM face WHERE image_id <> 7"))
def deleted_image(spark, sf_dir):
    return mutations.delete_image(library(spark, sf_dir), 7).face.select("id")


@register("migrated_faces", sql_of("SELECT id, '/old/' || (image_id % 50) || '/' || image_id || '.jpg' AS path, '/old/' || (image_id % 50) AS directory, cluster_id FROM face"))
def migrated_faces(spark, sf_dir):
    lib = library(spark, sf_dir)
    old = lib.face.select("id", F.expr("concat('/old/', image_id % 50, '/', image_id, '.jpg')").alias("image_path"), "cluster_id")
    now, _ = migrations.migrate({"person": lib.person, "cluster": lib.cluster, "face": old})
    return now.face.join(now.image.select(F.col("id").alias("image_id"), "path", "directory"), "image_id").select("id", "path", "directory", "cluster_id")
