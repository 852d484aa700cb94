"""Old snapshots read as today's: a ledger of schema versions, each a change of whole tables, applied in order and once.

A snapshot is a dict of tables. What version it has is told by its tables, so steps that
have been taken find nothing to do, and taking all of them twice changes no more than once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.library import Library
from shoebox.operators.mutations import merge_duplicate_images, next_id
from shoebox.schemas import SCHEMAS, conform
from shoebox.storage import numbered

Tables = dict[str, DataFrame]
_STEPS: list[tuple[int, str, Callable[[Tables], bool], Callable[[Tables], Tables]]] = []


def step(version: int, name: str, needed: Callable[[Tables], bool]):
    """Register a change: ``needed`` tells from the tables whether it is still to be made."""

    def keep(f: Callable[[Tables], Tables]):
        _STEPS.append((version, name, needed, f))
        _STEPS.sort(key=lambda s: s[0])
        return f

    return keep


def lacks(table: str, *columns: str) -> Callable[[Tables], bool]:
    return lambda t: table in t and not set(columns) <= set(t[table].columns)


def path_parts(path):
    """(directory, filename) of a path with either kind of separator; a path without one has an empty directory."""
    return F.regexp_replace(F.regexp_replace(path, r"[^/\\]*$", ""), r"(?<=.)[/\\]$", ""), F.regexp_extract(path, r"([^/\\]*)$", 1)


@step(1, "faces of paths", lambda t: "image_path" in t["face"].columns and "image_id" not in t["face"].columns)
def faces_of_paths(t: Tables) -> Tables:
    """Faces that name the path of their image get its id; images that only faces know are made, as processed ones. Faces without a path go."""
    face, image = t["face"].where("image_path is not null"), t.get("image")
    image = conform(image, "image") if image is not None else face.sparkSession.createDataFrame([], SCHEMAS["image"])
    paths = face.select(F.col("image_path").alias("path")).distinct().join(image.select("path"), "path", "left_anti")
    directory, filename = path_parts(F.col("path"))
    made = numbered(paths, "path").select((F.col("n") + next_id(image)).alias("id"), "path", directory.alias("directory"), filename.alias("filename"), F.lit(None).cast("string").alias("content_hash"), F.lit("1970-01-01").cast("timestamp").alias("processed_at"))
    image = image.unionByName(made.select(*image.columns))
    # of several images of one path the least id takes the faces
    by_path = image.groupBy("path").agg(F.min("id").alias("image_id"))
    rows = face.join(by_path, face["image_path"] == by_path["path"]).drop("path", "image_path")
    return t | {"face": rows.withColumn("review_status", F.lit("active")), "image": image}


@step(2, "states of faces", lacks("face", "review_status"))
def states_of_faces(t: Tables) -> Tables:
    return t | {"face": t["face"].withColumn("review_status", F.lit("active"))}


@step(3, "hashes of images", lacks("image", "content_hash", "processed_at"))
def hashes_of_images(t: Tables) -> Tables:
    return t | {"image": conform(t["image"], "image")}


@step(4, "locations of images", lambda t: "image_location" not in t)
def locations_of_images(t: Tables) -> Tables:
    """Each image lies where its path says; images of one content become one, which a processed one, then the least id, stands for."""
    image = conform(t["image"], "image")
    places = image.where("path is not null").groupBy("path").agg(F.min_by(F.struct(F.col("id").alias("image_id"), "directory", "filename"), "id").alias("r"))
    rows = numbered(places, "path").select((F.col("n") + 1).alias("id"), "r.image_id", "path", "r.directory", "r.filename")
    return t | {"image": image, "image_location": conform(rows, "image_location")}


@step(5, "times and sizes of locations", lacks("image_location", "created_at", "file_size", "modified_at_ns"))
def times_of_locations(t: Tables) -> Tables:
    return t | {"image_location": conform(t["image_location"], "image_location")}


def migrate(tables: Tables, hashes: DataFrame | None = None) -> tuple[Library, list[str]]:
    """(library, steps): a snapshot of any version as today's, and the names of the steps that it took.

    ``hashes`` (path, content_hash) are those of files that are still there, for images
    without one; images of one content are merged then. Tables that are missing are empty.
    """
    taken = []
    for _, name, needed, change in _STEPS:
        if needed(tables):
            tables = change(tables)
            taken.append(name)
    spark = tables["face"].sparkSession
    whole = {n: conform(tables[n], n) if n in tables else spark.createDataFrame([], SCHEMAS[n]) for n in Library.__dataclass_fields__}
    lib = Library(**whole)
    if hashes is not None:
        known = hashes.groupBy("path").agg(F.min("content_hash").alias("_h"))
        image = lib.image.join(known, "path", "left").withColumn("content_hash", F.coalesce("content_hash", "_h"))
        lib = lib.with_tables(image=image.select(*lib.image.columns))
        taken.append("hashes of files")
    return merge_duplicate_images(lib), taken
