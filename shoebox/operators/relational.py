"""Read queries of a library: filters, preferred locations, pages, counts, trees, people."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoebox.functions.text import name_key, rename_preview
from shoebox.library import Library
from shoebox.schemas import REVIEW_GROUPS, UNKNOWN
from shoebox.storage import numbered

MOST_ROWS = 200
#: People shown before a list is unfolded, names of sections.
COLLAPSED, GROUP_LABEL, LOOSE_LABEL = 12, "Gruppe ", "Einzelne Gesichter"


def in_folders(directory: Column, folders: Sequence[str]) -> Column:
    """Whether a directory is one of the folders or lies below one; no folders take everything."""
    found = F.lit(not folders)
    for f in folders:
        root = f.rstrip("/\\")
        found = found | (directory == root) | directory.startswith(root + "/") | directory.startswith(root + "\\")
    return found


def preferred_location(locations: DataFrame, folders: Sequence[str] = ()) -> DataFrame:
    """The location of least path of each image, among those inside the folders."""
    inside = locations.where(in_folders(F.col("directory"), folders))
    return inside.withColumn("_rank", F.expr("row_number() over (partition by image_id order by path)")).where("_rank = 1").drop("_rank")


def named_faces(lib: Library) -> DataFrame:
    """Faces with the label and person of their cluster."""
    cluster = lib.cluster.select(F.col("id").alias("cluster_id"), "label", "person_id")
    person = lib.person.select(F.col("id").alias("person_id"), F.col("name").alias("person_name"))
    return lib.face.join(cluster, "cluster_id", "left").join(person, "person_id", "left")


def images_of_persons(lib: Library, persons: Sequence[str]) -> DataFrame:
    """image_id of the images whose active faces show all the people asked for; faces of nobody count as one name."""
    keys = list(dict.fromkeys(p.strip().casefold() for p in persons if p and p.strip()))
    key = name_key(F.coalesce("person_name", F.lit(UNKNOWN)))
    active = named_faces(lib).where("review_status = 'active'").withColumn("_key", key).where(F.col("_key").isin(keys))
    return active.groupBy("image_id").agg(F.count_distinct("_key").alias("n")).where(F.col("n") == len(keys)).select("image_id")


def matching_images(lib: Library, folders: Sequence[str] = (), persons: Sequence[str] = (), statuses: Sequence[str] = ()) -> DataFrame:
    """(image_id, path, directory, filename, created_at) of the images that pass the folder, person and status filters.

    Archived faces are hidden; asking for their status makes them count.
    """
    statuses = [s for s in statuses if s in ("unknown_person", "not_face")]
    shown = lib.face.where(F.col("review_status").isin("active", *statuses)).select("image_id")
    found = preferred_location(lib.image_location, folders).select("image_id", "path", "directory", "filename", "created_at")
    found = found.join(lib.image.select(F.col("id").alias("image_id")), "image_id", "left_semi").join(shown, "image_id", "left_semi")
    if any(p and p.strip() for p in persons):
        found = found.join(images_of_persons(lib, persons), "image_id", "left_semi")
    if statuses:
        found = found.join(lib.face.where(F.col("review_status").isin(*statuses)).select("image_id"), "image_id", "left_semi")
    return found


def image_order(sort_by: str = "date", direction: str = "desc") -> list[Column]:
    """Sort keys: by date with undated last, or by folder; names and paths, then the id, settle ties."""
    down = direction != "asc"
    ties = [F.lower("filename"), F.lower("path"), F.col("image_id")]
    if sort_by == "folder":
        return [F.lower("directory").desc() if down else F.lower("directory").asc(), *ties]
    return [F.col("created_at").desc_nulls_last() if down else F.col("created_at").asc_nulls_last(), *ties]


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows offset to offset + limit, from 1 to MOST_ROWS of them."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(MOST_ROWS, max(1, limit)))


def image_page(lib: Library, folders=(), persons=(), statuses=(), sort_by="date", direction="desc", limit=40, offset=0) -> DataFrame:
    """The faces and number of locations of a page of images: the page is cut before faces are joined."""
    rows = page(matching_images(lib, folders, persons, statuses), image_order(sort_by, direction), limit, offset)
    # what is counted and named is the page's alone
    shown = rows.select("image_id")
    counts = lib.image_location.join(shown, "image_id", "left_semi").groupBy("image_id").agg(F.count("*").alias("location_count"))
    faces = named_faces(lib.with_tables(face=lib.face.join(shown, "image_id", "left_semi"))).where(F.col("review_status").isin("active", *statuses)).select("image_id", F.col("id").alias("face_id"), "bbox_x", "cluster_id", "person_name", "review_status")
    # a page is short, so its order is put back after the joins; faces stand from the left
    return rows.join(counts, "image_id", "left").join(faces, "image_id", "left").orderBy(*image_order(sort_by, direction), "bbox_x", "face_id")


def image_documents(lib: Library, rows: DataFrame) -> DataFrame:
    """One row for each image: its faces by place from the left, and its locations by path, nested."""
    faces = named_faces(lib).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("bbox_x", F.col("id").alias("face_id"), "cluster_id", "person_name", "review_status"))).alias("faces"))
    locations = lib.image_location.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("path", "directory", "filename", F.col("id").alias("location_id")))).alias("locations"))
    return rows.join(faces, "image_id", "left").join(locations, "image_id", "left")


def image_total(lib: Library, folders=(), persons=(), statuses=()) -> DataFrame:
    return matching_images(lib, folders, persons, statuses).agg(F.count("*").alias("total"))


def image_detail(lib: Library, image_id: int) -> DataFrame:
    one = preferred_location(lib.image_location.where(F.col("image_id") == image_id)).select("image_id", "path")
    faces = named_faces(lib).where(F.col("image_id") == image_id)
    return one.join(faces.select("image_id", F.col("id").alias("face_id"), "bbox_x", "cluster_id", "person_name", "review_status"), "image_id", "left")


def available_path(locations: DataFrame, preferred: str | None = None) -> DataFrame:
    """For each image the first location that exists: the preferred path, else the least. Needs a column ``exists``."""
    other = F.col("path") != F.lit(preferred) if preferred else F.lit(False)
    return locations.where("exists").groupBy("image_id").agg(F.min(F.struct(other.alias("other"), "path")).alias("r")).select("image_id", "r.path")


def face_crops(faces: DataFrame, locations: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(face_id, path, x, y, w, h) of the faces ``wanted`` (id; all without it): the first location of its image that exists, and its box in whole pixels, cut towards 0.

    A face whose image has no location that exists, and an id that no face has, give no row;
    a number that is missing or not finite is 0. The faces wanted choose the locations that are read.
    """
    if wanted is not None:
        faces = faces.join(wanted.select("id").distinct(), "id", "left_semi")
    whole = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")).otherwise(0.0).cast("int")
    boxes = faces.select(F.col("id").alias("face_id"), "image_id", *(whole(f"bbox_{c}").alias(c) for c in "xywh"))
    near = locations if wanted is None else locations.join(boxes.select("image_id"), "image_id", "left_semi")
    return boxes.join(available_path(near), "image_id").select("face_id", "path", *"xywh")


def available_persons(lib: Library, folders: Sequence[str] = ()) -> DataFrame:
    images = lib.image_location.where(in_folders(F.col("directory"), folders)).select("image_id")
    return named_faces(lib).where("review_status = 'active'").join(images, "image_id", "left_semi").select(F.coalesce("person_name", F.lit(UNKNOWN)).alias("person_name")).distinct()


def folder_tree(lib: Library) -> DataFrame:
    """(path, parent, name, depth, direct_image_count, image_count) of every folder and its ancestors, over processed images.

    An image's folders are gathered first and their ancestors told apart inside its row, so an
    image makes one row for each folder that it counts in, and these are only added up.
    """
    processed = lib.image.where("processed_at is not null").select(F.col("id").alias("image_id"))
    placed = lib.image_location.groupBy("image_id").agg(F.collect_set("directory").alias("own")).join(processed, "image_id", "left_semi")

    def ancestors(directory: Column) -> Column:
        parts = F.filter(F.split(directory, "/"), lambda p: p != "")
        return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))

    each = placed.select("own", F.explode(F.array_distinct(F.flatten(F.transform("own", ancestors)))).alias("path"))
    counted = each.groupBy("path").agg(F.sum(F.array_contains("own", F.col("path")).cast("int")).alias("direct_image_count"), F.count("*").alias("image_count"))
    parent = F.when(F.col("path") != "/", F.when(F.expr("instr(substr(path, 2), '/')") == 0, "/").otherwise(F.regexp_replace("path", r"/[^/]*$", "")))
    name = F.when(F.col("path") == "/", "/").otherwise(F.element_at(F.split("path", "/"), -1))
    depth = F.when(F.col("path") == "/", 0).otherwise(F.size(F.split("path", "/")) - 1)
    return counted.select("path", parent.alias("parent"), name.alias("name"), depth.alias("depth"), "direct_image_count", "image_count")


def folder_search(tree: DataFrame, text: str) -> DataFrame:
    """Folders whose name holds the text, and all that they lie in."""
    hits = tree.where(F.lower("name").contains(text.lower()))
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    kept = hits.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))).alias("path")).distinct()
    return tree.join(kept, "path", "left_semi")


def cluster_summaries(lib: Library) -> DataFrame:
    """(cluster_id, cluster_label, person_name, face_count) of clusters with active faces; counted before names are joined."""
    counts = lib.face.where("review_status = 'active' and cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("face_count"))
    person = lib.person.select(F.col("id").alias("person_id"), F.col("name").alias("person_name"))
    return lib.cluster.select(F.col("id").alias("cluster_id"), F.col("label").alias("cluster_label"), "person_id").join(counts, "cluster_id").join(person, "person_id", "left").select("cluster_id", "cluster_label", "person_name", "face_count")


def summary_order() -> list[Column]:
    return [F.desc("face_count"), F.expr("coalesce(trim(person_name), '') = ''"), F.lower(F.coalesce("person_name", F.lit(UNKNOWN))), F.asc("cluster_id")]


def cluster_previews(lib: Library, most: int = 6) -> DataFrame:
    """(cluster_id, face_ids): the first active faces of each cluster."""
    ranked = lib.face.where("review_status = 'active' and cluster_id is not null").withColumn("_rank", F.expr("row_number() over (partition by cluster_id order by id)"))
    return ranked.where(F.col("_rank") <= most).groupBy("cluster_id").agg(F.array_sort(F.collect_list("id")).alias("face_ids"))


def review_group() -> Column:
    """The review group of a face, null if it waits in none."""
    return F.when(F.col("review_status") != "active", F.col("review_status")).when(F.col("cluster_id").isNull(), "unassigned")


def review_groups(lib: Library) -> DataFrame:
    """The three review groups with their faces and clusters, a loose face counting as a cluster; empty ones too."""
    spark = lib.face.sparkSession
    every = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(REVIEW_GROUPS.items())], "place int, group_key string, label string")
    faces = lib.face.withColumn("group_key", review_group()).where("group_key is not null")
    # clusters are counted as grouped rows, so a group's clusters need no set in one task
    units = faces.groupBy("group_key", F.coalesce("cluster_id", -F.col("id") - 1).alias("unit")).agg(F.count("*").alias("n"))
    counts = units.groupBy("group_key").agg(F.sum("n").alias("face_count"), F.count("*").alias("cluster_count"))
    return every.join(counts, "group_key", "left").select("place", "group_key", "label", F.coalesce("face_count", F.lit(0)).alias("face_count"), F.coalesce("cluster_count", F.lit(0)).alias("cluster_count"))


def review_group_faces(lib: Library, group_key: str) -> DataFrame:
    return named_faces(lib).withColumn("group_key", review_group()).where(F.col("group_key") == group_key).select(F.col("id").alias("face_id"), "image_id", "cluster_id", F.col("label").alias("cluster_label"), "person_name")


def person_list(lib: Library) -> DataFrame:
    """People by name, without regard to case, then id."""
    return lib.person.select("id", "name").orderBy(F.lower("name"), "id")


def person_faces(lib: Library, person_id: int) -> DataFrame:
    return named_faces(lib).where(F.col("person_id") == person_id).select(F.col("id").alias("face_id"), "image_id", "cluster_id", "review_status").orderBy("face_id")


def person_rollup(lib: Library) -> DataFrame:
    """(person_name, cluster_count, face_count, cluster_ids) over clusters of people."""
    named = cluster_summaries(lib).where("person_name is not null")
    return named.groupBy("person_name").agg(F.count("*").alias("cluster_count"), F.sum("face_count").alias("face_count"), F.array_join(F.array_sort(F.collect_list("cluster_id")), ",").alias("cluster_ids"))


def face_totals(lib: Library) -> DataFrame:
    """Faces in the inbox, faces that a reclustering may move, and all."""
    is_active = F.col("review_status") == "active"
    return lib.face.agg(
        F.count_if(is_active & F.col("cluster_id").isNull()).alias("inbox"), F.count_if(is_active).alias("reclusterable"), F.count("*").alias("faces"), F.max("id").alias("max_id"),
    )


def unassigned_pool(lib: Library) -> DataFrame:
    """Active faces of no person: loose, or in clusters without one."""
    return named_faces(lib).where("review_status = 'active' and person_id is null").select(F.col("id").alias("face_id"), "cluster_id")


def orphan_clusters(lib: Library) -> DataFrame:
    return lib.cluster.join(lib.face.select(F.col("cluster_id").alias("id")), "id", "left_anti").select("id")


def missing_clusters(lib: Library) -> DataFrame:
    return lib.face.where("cluster_id is not null").select(F.col("cluster_id").alias("id")).distinct().join(lib.cluster, "id", "left_anti")


def broken_person_refs(lib: Library) -> DataFrame:
    return lib.cluster.where("person_id is not null").join(lib.person.select(F.col("id").alias("person_id")), "person_id", "left_anti").select("id", "person_id")


def duplicate_content(files: DataFrame) -> DataFrame:
    """(content_hash, n, canonical_id): contents that several ids share; processed ones first, then the least id, stand for them."""
    counted = files.groupBy("content_hash").agg(F.count("*").alias("n"), F.min_by("id", F.struct(F.expr("int(processed_at is null)"), "id")).alias("canonical_id"))
    return counted.where("n > 1")


def name_groups(person: DataFrame) -> DataFrame:
    """(key, n, canonical_id): people whose names differ in case or outer spaces; a trimmed spelling stands for them, then the least id."""
    order = F.struct(F.expr("int(name <> trim(name))"), "id")
    return person.groupBy(name_key(F.col("name")).alias("key")).agg(F.count("*").alias("n"), F.min_by("id", order).alias("canonical_id"))


def changed_files(seen: DataFrame, known: DataFrame) -> DataFrame:
    """(path, changed): a file is unchanged if it is known, processed, and of the same size and time."""
    old = known.select("path", F.col("file_size").alias("_size"), F.col("modified_at_ns").alias("_time"), F.col("processed_at").alias("_done"))
    same = F.col("_done").isNotNull() & F.col("file_size").eqNullSafe(F.col("_size")) & F.col("modified_at_ns").eqNullSafe(F.col("_time"))
    return seen.join(old, "path", "left").select("path", (~F.coalesce(same, F.lit(False))).alias("changed"))


def rename_candidates(lib: Library, folders=(), persons=()) -> DataFrame:
    """(location_id, path, current_filename, proposed_filename, ...) of the locations of matching images whose name should change.

    Names come in the order of faces from the left.
    """
    named = named_faces(lib).where("person_name is not null").groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bbox_x", "id", "person_name"))), lambda s: s["person_name"]).alias("names"))
    places = lib.image_location.join(matching_images(lib, folders, persons).select("image_id"), "image_id", "left_semi").join(named, "image_id")
    shown = places.withColumn("r", rename_preview(F.col("filename"), F.col("names"))).where("r.proposed_filename is not null")
    return shown.select(F.col("id").alias("location_id"), "image_id", "path", "directory", "created_at", "r.*")


def rename_plan(candidates: DataFrame, excluded: Sequence[str] | DataFrame = (), existing: DataFrame | None = None) -> DataFrame:
    """(path, target, status): what a renaming would do; a target that exists, or that two files want, is skipped. ``excluded`` paths are a list or a table (path)."""
    if not isinstance(excluded, DataFrame):
        excluded = candidates.sparkSession.createDataFrame([(p,) for p in excluded], "path string")
    plan = candidates.join(excluded.select("path"), "path", "left_anti").withColumn("target", F.concat_ws("/", "directory", "proposed_filename"))
    taken = plan.groupBy("target").agg(F.count("*").alias("_n"))
    plan = plan.join(taken, "target")
    if existing is not None:
        plan = plan.join(existing.select(F.col("path").alias("target"), F.lit(True).alias("_there")), "target", "left")
    else:
        plan = plan.withColumn("_there", F.lit(None).cast(T.BooleanType()))
    return plan.select("path", "target", F.when(F.col("_there"), "exists").when(F.col("_n") > 1, "clash").otherwise("rename").alias("status"))


def search_clusters(lib: Library, text: str) -> DataFrame:
    """Clusters whose person, label, number or group name holds the text."""
    q = text.lower()
    hit = F.lower(F.coalesce("person_name", F.lit(""))).contains(q) | F.lower(F.coalesce("cluster_label", F.lit(""))).contains(q) | F.concat(F.lit("gruppe "), F.col("cluster_id").cast("string")).contains(q)
    return cluster_summaries(lib).where(hit)


def rename_order(sort_by: str = "date", direction: str = "desc") -> list[Column]:
    """Sort keys of renaming candidates: by date with undated last either way, or by folder; then file name and path without case."""
    up = direction == "asc"
    ties = [F.lower("current_filename"), F.lower("path"), F.col("location_id")]
    if sort_by == "folder":
        return [F.lower("directory").asc() if up else F.lower("directory").desc(), *ties]
    return [F.col("created_at").asc_nulls_last() if up else F.col("created_at").desc_nulls_last(), *ties]


def rename_page(candidates: DataFrame, limit: int = 40, offset: int = 0, sort_by: str = "date", direction: str = "desc") -> DataFrame:
    """A page of renaming candidates in ``rename_order``: what is to change is filtered before the page is cut."""
    return page(candidates, rename_order(sort_by, direction), limit, offset)


def rename_total(candidates: DataFrame) -> DataFrame:
    """(locations, images) that should change their name."""
    images = candidates.select("image_id").distinct().agg(F.count("*").alias("images")).withColumn("_one", F.lit(1))
    # either side is one row
    return candidates.agg(F.count("*").alias("locations")).withColumn("_one", F.lit(1)).join(images, "_one").drop("_one")


def rename_by_paths(candidates: DataFrame, paths: DataFrame, sort_by: str = "date", direction: str = "desc") -> DataFrame:
    """The candidates of ``paths`` (path) in ``rename_order``; paths that need no change give no row."""
    return candidates.join(paths.select("path"), "path", "left_semi").orderBy(*rename_order(sort_by, direction))


def in_asked_order(rows: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """The ``rows`` whose key was asked for, in the order of asking: ``asked`` has the key and its place; of a key asked twice the first place counts."""
    first = asked.groupBy(key).agg(F.min("place").alias("place"))
    return rows.join(first, key).orderBy("place")


def person_picker(lib: Library, selected: Sequence[str] = (), search: str = "", collapsed: int | None = COLLAPSED, folders: Sequence[str] = ()) -> DataFrame:
    """(name, selected) of the people to choose from: those of active faces and the selected ones, these first, then by name without case.

    Nobody's name isn't offered. A search narrows the list and shows all of it; else
    ``collapsed`` are shown (None: all), and never less than are selected.
    """
    spark = lib.face.sparkSession
    mine = spark.createDataFrame([(n,) for n in dict.fromkeys(selected)], "name string").withColumn("selected", F.lit(True))
    names = available_persons(lib, folders).select(F.col("person_name").alias("name")).unionByName(mine.select("name")).where(F.col("name") != UNKNOWN).distinct()
    found = names.join(mine, "name", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
    query = search.strip().lower()
    if query:
        found = found.where(F.lower("name").contains(query))
    found = found.orderBy(F.desc("selected"), F.lower("name"), "name")
    return found if query or collapsed is None else found.limit(max(collapsed, len(set(selected))))


def archive_sections(lib: Library, status: str) -> DataFrame:
    """(place, key, label, cluster_id, face_count) of the archived faces of one review status: a section for each cluster, most faces first, ties by least face, and the loose ones last.

    A section has its cluster's label where active faces show that too, else its number.
    """
    labels = cluster_summaries(lib).select("cluster_id", F.trim("cluster_label").alias("_label"))
    faces = lib.face.where(F.col("review_status") == status).groupBy("cluster_id").agg(F.count("*").alias("face_count"), F.min("id").alias("_least"))
    loose = F.col("cluster_id").isNull()
    number = F.col("cluster_id").cast("string")
    named = faces.join(labels, "cluster_id", "left").select(
        F.when(loose, "ungrouped").otherwise(F.concat(F.lit("cluster-"), number)).alias("key"),
        F.when(loose, LOOSE_LABEL).when(F.coalesce("_label", F.lit("")) != "", F.col("_label")).otherwise(F.concat(F.lit(GROUP_LABEL), number)).alias("label"),
        "cluster_id", "face_count", loose.alias("_loose"), (-F.col("face_count")).alias("_down"), "_least",
    )
    return numbered(named, "_loose", "_down", "_least", name="place").select("place", "key", "label", "cluster_id", "face_count")


def archive_section_faces(lib: Library, status: str) -> DataFrame:
    """(place, face_id, image_id): the faces of the sections, by id."""
    sections = archive_sections(lib, status).select("place", "cluster_id")
    faces = lib.face.where(F.col("review_status") == status)
    return faces.join(sections, faces["cluster_id"].eqNullSafe(sections["cluster_id"])).select("place", F.col("id").alias("face_id"), "image_id")


def active_vectors(lib: Library) -> DataFrame:
    """(id, cluster_id, person_id, embedding) of active faces with a vector; -1 for no cluster and no person."""
    faces = named_faces(lib).where("review_status = 'active' and embedding is not null")
    none = F.lit(-1).cast("bigint")
    return faces.select("id", F.coalesce("cluster_id", none).alias("cluster_id"), F.coalesce("person_id", none).alias("person_id"), "embedding")


def after_id(rows: DataFrame, last: int | None, limit: int) -> DataFrame:
    """The next ``limit`` rows by id after the last one seen: a keyset page."""
    rest = rows if last is None else rows.where(F.col("id") > last)
    return rest.orderBy("id").limit(max(1, limit))


def first_cluster(lib: Library) -> DataFrame:
    """The summary that stands first."""
    return cluster_summaries(lib).orderBy(*summary_order()).limit(1)


def overview(lib: Library) -> DataFrame:
    """(part, place, id, label, person_name, face_count): what the cluster page starts from.

    Part ``cluster`` has all summaries in their order, ``group`` the three review groups,
    ``face`` the active faces of the cluster that stands first, in similarity order where
    faces have vectors (column ``vec``), those without last, by id.
    """
    from shoebox.operators.clustering import similarity_order

    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    keyed = cluster_summaries(lib).withColumns({"_down": -F.col("face_count"), "_none": F.expr("coalesce(trim(person_name), '') = ''"), "_name": F.lower(F.coalesce("person_name", F.lit(UNKNOWN)))})
    clusters = numbered(keyed, "_down", "_none", "_name", "cluster_id", name="place")
    groups = review_groups(lib)
    top = first_cluster(lib).select("cluster_id")
    faces = lib.face.where("review_status = 'active'").join(top, "cluster_id", "left_semi")
    vec = F.col("vec") if "vec" in lib.face.columns else F.lit(None).cast("array<double>")
    shown = similarity_order(faces.select("id", "cluster_id", vec.alias("vec")))
    part = lambda name: F.lit(name).alias("part")
    columns = [F.col("place").cast("bigint").alias("place")]
    out = clusters.select(part("cluster"), *columns, F.col("cluster_id").alias("id"), F.col("cluster_label").alias("label"), "person_name", "face_count")
    out = out.unionByName(groups.select(part("group"), *columns, *none("bigint", "id"), "label", *none("string", "person_name"), "face_count"))
    return out.unionByName(shown.select(part("face"), *columns, "id", *none("string", "label", "person_name"), *none("bigint", "face_count")))


def _previews(lib: Library, suggestions: DataFrame) -> DataFrame:
    shown = cluster_previews(lib).select("cluster_id", F.col("face_ids").alias("preview_face_ids"))
    return suggestions.join(shown, "cluster_id", "left")


def person_suggestion_list(lib: Library) -> DataFrame:
    """Pending proposals of people for clusters without one, with the first faces: by name without case, then confidence and size, largest first."""
    free = lib.cluster.where("person_id is null").select(F.col("id").alias("cluster_id"))
    names = lib.person.select(F.col("id").alias("person_id"), F.col("name").alias("person_name"))
    pending = lib.cluster_person_suggestion.where("status = 'pending'").drop("status").join(free, "cluster_id", "left_semi").join(names, "person_id")
    found = _previews(lib, pending.withColumn("recommended", F.col("confidence") >= 0.72))
    return found.orderBy(F.lower("person_name"), F.desc("confidence"), F.desc("face_count"), "cluster_id")


def review_suggestion_list(lib: Library) -> DataFrame:
    """Pending proposals of review states with the first faces, by confidence and size, largest first."""
    pending = lib.cluster_review_suggestion.where("status = 'pending'").drop("status").withColumn("recommended", F.col("confidence") >= 0.80)
    return _previews(lib, pending).orderBy(F.desc("confidence"), F.desc("face_count"), "cluster_id")


def suggestions_by_person(lib: Library) -> DataFrame:
    """(person_id, person_name, clusters, faces, recommended): pending proposals summed up for each person."""
    pending = person_suggestion_list(lib)
    return pending.groupBy("person_id", "person_name").agg(F.count("*").alias("clusters"), F.sum("face_count").cast("bigint").alias("faces"), F.count_if("recommended").alias("recommended"))
