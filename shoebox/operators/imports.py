"""Importing files: what a batch of hashed files and detected faces changes in a library.

A batch becomes a delta: rows that are new or changed, and rows that go (``gone``), by
table. New ids are dense and are handed out by ranges, so a large batch needs no counter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.library import Library
from shoebox.operators.mutations import next_id
from shoebox.operators.relational import changed_files
from shoebox.storage import numbered, settled

#: Labels of clusters that an import makes.
PROPOSED_LABEL, FRESH_LABEL = "Cluster ", "Neue Gesichtsgruppe"
#: What tells the rows of a table apart.
KEYS = {"image": "id", "image_location": "path", "face": "id", "cluster": "id"}
Delta = dict[str, DataFrame]


def resolve_clusters(lib: Library, proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, made): ``proposals`` (image_id, proposed, ...) with a cluster_id, and the cluster rows that this makes.

    A proposal stands unless its cluster is a person's: a person's cluster never takes an
    imported face, so all faces of an image with one such proposal share a fresh cluster of
    nobody. A proposed number that no cluster has becomes one. Fresh numbers follow all
    others, in order of image and proposal; a missing proposal stays without a cluster.
    """
    owner = lib.cluster.select(F.col("id").alias("proposed"), "person_id", F.lit(True).alias("_there"))
    seen = settled(proposals.join(owner, "proposed", "left"))
    top = max(next_id(lib.cluster), *((df.agg(F.max(c)).first()[0] or 0) + 1 for df, c in ((seen, "proposed"), (lib.face, "cluster_id"))))
    owned = seen.where("person_id is not null").select("image_id", "proposed").distinct()
    fresh = numbered(owned, "image_id", "proposed").select("image_id", "proposed", (F.col("n") + top).alias("_fresh"))
    resolved = seen.join(fresh, ["image_id", "proposed"], "left").withColumn("cluster_id", F.coalesce("_fresh", "proposed").cast("bigint"))
    none = F.lit(None).cast("bigint").alias("person_id")
    unknown = seen.where("_there is null and proposed is not null").select(F.col("proposed").cast("bigint").alias("id")).distinct()
    made = unknown.select("id", F.concat(F.lit(PROPOSED_LABEL), F.col("id")).alias("label"), none).unionByName(fresh.select(F.col("_fresh").alias("id"), F.lit(FRESH_LABEL).alias("label"), none))
    return resolved.select(*proposals.columns, "cluster_id"), made


def to_import(lib: Library, files: DataFrame) -> DataFrame:
    """The files, one for each path, that are new, or that differ in size or time from a processed one."""
    known = lib.image_location.join(lib.image.select(F.col("id").alias("image_id"), "processed_at"), "image_id").select("path", "file_size", "modified_at_ns", "processed_at")
    once = files.dropDuplicates(["path"])
    fresh = changed_files(once, known).where("changed").select("path")
    return once.join(fresh, "path", "left_semi")


def import_delta(lib: Library, files: DataFrame, faces: DataFrame, at) -> Delta:
    """What importing a batch changes.

    ``files`` has path, directory, filename, created_at, file_size, modified_at_ns and
    content_hash; ``faces`` has content_hash, place, bbox_x, bbox_y, bbox_w, bbox_h,
    embedding and proposed (a cluster, or null); ``at`` is the time of processing. Files
    that ``to_import`` passes over change nothing. Content that a processed image has only
    gets the location. Other content is one image, whatever number of paths it has; its
    least path stands for it and its faces are taken anew. A path whose content changed
    leaves its old image, which goes with its faces once it has no path left. Clusters
    that lose their last face go. Faces of content that isn't in the batch are ignored.
    """
    new = settled(to_import(lib, files))
    held = lib.image.where("content_hash is not null").groupBy("content_hash").agg(F.min_by(F.struct("id", "processed_at"), F.struct(F.col("processed_at").isNull(), "id")).alias("_i"))
    contents = new.groupBy("content_hash").agg(F.min("path").alias("path"), F.min_by("directory", "path").alias("directory"), F.min_by("filename", "path").alias("filename")).join(held, "content_hash", "left")
    contents = settled(contents)
    first = next_id(lib.image)
    known = contents.where("_i is not null").select("content_hash", "path", "directory", "filename", F.col("_i.id").alias("image_id"), F.col("_i.processed_at").alias("processed_at"))
    made = numbered(contents.where("_i is null").drop("_i"), "content_hash").select("content_hash", "path", "directory", "filename", (F.col("n") + first).alias("image_id"), F.lit(None).cast(dict(lib.image.dtypes)["processed_at"]).alias("processed_at"))
    target = settled(known.unionByName(made))

    # locations: a path that stays with its image keeps its number
    placed = new.join(target.select("content_hash", "image_id"), "content_hash")
    old = lib.image_location.select("path", F.col("id").alias("_id"), F.col("image_id").alias("_image"))
    placed = settled(placed.join(old, "path", "left"))
    stays = F.col("_image").eqNullSafe(F.col("image_id"))
    moved = numbered(placed.where(~stays | F.col("_image").isNull()), "path").withColumn("id", F.col("n") + next_id(lib.image_location)).drop("n")
    locations = placed.where(stays & F.col("_image").isNotNull()).withColumn("id", F.col("_id")).unionByName(moved)

    # images that a changed path has left, and that have no other path
    left = placed.where("_image is not null and _image <> image_id").select(F.col("_image").alias("image_id")).distinct()
    kept = lib.image_location.join(placed.select("path"), "path", "left_anti").select("image_id").unionByName(locations.select("image_id"))
    empty = settled(left.join(kept, "image_id", "left_anti"))
    still = left.join(empty, "image_id", "left_anti")
    paths = kept_paths(lib, placed, still)

    work = target.where("processed_at is null").select("image_id", "content_hash", "path", "directory", "filename")
    image_columns = lib.image.columns
    worked = work.join(lib.image.select(F.col("id").alias("image_id"), *(c for c in image_columns if c not in ("id", "content_hash", "path", "directory", "filename", "processed_at"))), "image_id", "left")
    rows = worked.withColumn("id", F.col("image_id")).withColumn("processed_at", F.lit(at).cast(dict(lib.image.dtypes)["processed_at"])).select(*image_columns)
    images = rows.withColumn("gone", F.lit(False)).unionByName(paths.select(*image_columns).withColumn("gone", F.lit(False)))
    images = images.unionByName(lib.image.join(empty, lib.image["id"] == empty["image_id"], "left_semi").select(*image_columns).withColumn("gone", F.lit(True)))

    proposals = faces.join(work.select("content_hash", "image_id"), "content_hash")
    resolved, clusters = resolve_clusters(lib, proposals)
    start = next_id(lib.face)
    fresh = numbered(resolved, "image_id", "place").withColumn("id", F.col("n") + start).withColumn("review_status", F.lit("active"))
    fresh = settled(fresh.select(*(c for c in lib.face.columns)))
    again = work.select("image_id").unionByName(empty)
    lost = settled(lib.face.join(again, "image_id", "left_semi").select(*lib.face.columns))
    used = lib.face.join(lost.select("id"), "id", "left_anti").select("cluster_id").unionByName(fresh.select("cluster_id"))
    dead = lost.where("cluster_id is not null").select("cluster_id").distinct().join(used, "cluster_id", "left_anti")
    dead = lib.cluster.join(dead, lib.cluster["id"] == dead["cluster_id"], "left_semi").select("id", "label", "person_id")
    mark = lambda df, gone: df.withColumn("gone", F.lit(gone))
    return {
        "image": images,
        "image_location": mark(locations.select(*lib.image_location.columns), False),
        "face": mark(fresh, False).unionByName(mark(lost, True)),
        "cluster": mark(clusters, False).unionByName(mark(dead, True)),
    }


def kept_paths(lib: Library, placed: DataFrame, images: DataFrame) -> DataFrame:
    """Rows of images that lost a path but have others: the least one left stands for them if theirs is lost."""
    rest = lib.image_location.join(images, "image_id", "left_semi").join(placed.select("path"), "path", "left_anti")
    best = rest.groupBy("image_id").agg(F.min(F.struct("path", "directory", "filename")).alias("_l"))
    rows = lib.image.join(best, lib.image["id"] == best["image_id"])
    own = [c for c in ("path", "directory", "filename") if c in lib.image.columns]
    return rows.join(placed.select(F.col("path").alias("_gone")), rows["path"] == F.col("_gone"), "left_semi").withColumns({c: F.col(f"_l.{c}") for c in own}) if own else rows.where("false")


def apply_delta(lib: Library, delta: Delta) -> Library:
    """The library with the rows of a delta in place of those of equal keys."""
    out = {}
    for name, rows in delta.items():
        table, key = getattr(lib, name), KEYS[name]
        columns = rows.drop("gone").columns
        out[name] = table.select(*columns).join(rows.select(key), key, "left_anti").select(*columns).unionByName(rows.where("not gone").select(*columns))
    return lib.with_tables(**out)


def latest(deltas: DataFrame, key: str) -> DataFrame:
    """Of the rows of several batches the one of the newest batch for each key; a key's rows are few, one a batch."""
    return deltas.withColumn("_r", F.expr(f"row_number() over (partition by {key} order by batch desc, gone)")).where("_r = 1").drop("_r", "batch")
