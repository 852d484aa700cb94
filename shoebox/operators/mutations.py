"""Changes of a library: each takes a snapshot and returns the changed one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.functions.text import name_key
from shoebox.library import Library
from shoebox.operators.reclustering import recluster
from shoebox.schemas import FACE_STATUSES


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``new`` in place of those of equal keys."""
    return old.join(new.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def insert_missing(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``old`` and the rows of ``new`` whose keys it lacks, one for each key."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def next_id(df: DataFrame) -> int:
    return (df.agg(F.max("id")).first()[0] or 0) + 1


def checked_ids(ids: Sequence[int]) -> list[int]:
    found = list(dict.fromkeys(int(i) for i in ids if int(i) > 0))
    if not found:
        raise ValueError("no valid face ids")
    return found


def id_table(lib: Library, ids: Sequence[int] | DataFrame) -> DataFrame:
    """Face ids, given as a list or as a table (id), as a table of positive ids, once each; none at all is an error."""
    if isinstance(ids, DataFrame):
        found = ids.select(F.col("id").cast("bigint").alias("id")).where("id > 0").distinct()
        if not found.limit(1).count():
            raise ValueError("no valid face ids")
        return found
    return lib.face.sparkSession.createDataFrame([(i,) for i in checked_ids(ids)], "id bigint")


def _marked(face: DataFrame, ids: DataFrame) -> DataFrame:
    """``face`` with _in: whether a row is among the ids."""
    return face.join(ids.withColumn("_in", F.lit(True)), "id", "left").withColumn("_in", F.coalesce("_in", F.lit(False)))


def owners_of(lib: Library, ids: DataFrame) -> DataFrame:
    """(person_id) of the people whose clusters hold some of the faces."""
    held = lib.face.join(ids, "id", "left_semi").select("cluster_id")
    return lib.cluster.where("person_id is not null").join(held, lib.cluster["id"] == held["cluster_id"], "left_semi").select("person_id").distinct()


def mark_dirty(lib: Library, persons: DataFrame) -> Library:
    """Note people (null: nobody's pool) whose groups are to be rebuilt."""
    fresh = persons.select(F.coalesce(F.col("person_id").cast("bigint"), F.lit(-1)).alias("person_id")).distinct()
    held = lib.recluster_dirty_person
    return lib.with_tables(recluster_dirty_person=fresh if held is None else held.unionByName(fresh).distinct())


def drop_empty_clusters(lib: Library) -> Library:
    return lib.with_tables(cluster=lib.cluster.join(lib.face.select(F.col("cluster_id").alias("id")), "id", "left_semi"))


def repair(lib: Library) -> Library:
    """Cluster 0 gets a positive id, clusters that faces name are made, links to missing people are cut, empty clusters go; twice changes no more than once."""
    fresh = max(next_id(lib.cluster), (lib.face.agg(F.max("cluster_id")).first()[0] or 0) + 1)
    moved = lambda c: F.when(F.col(c) == 0, fresh).otherwise(F.col(c)).cast("bigint").alias(c)
    face = lib.face.withColumn("cluster_id", moved("cluster_id")).withColumn("review_status", F.when(F.col("review_status").isin(*FACE_STATUSES), F.col("review_status")).otherwise("active"))
    cluster = lib.cluster.withColumn("id", moved("id"))
    used = face.where("cluster_id is not null").select(F.col("cluster_id").alias("id")).distinct()
    cluster = used.join(cluster, "id", "left").select(*lib.cluster.columns)
    there = lib.person.select(F.col("id").alias("_person"), F.lit(True).alias("_there"))
    cluster = cluster.join(there, cluster["person_id"] == there["_person"], "left").withColumn("person_id", F.when(F.col("_there"), F.col("person_id"))).select(*lib.cluster.columns)
    return lib.with_tables(face=face, cluster=cluster)


def merge_people(lib: Library) -> Library:
    """People whose names differ only in case and outer spaces become one: a trimmed spelling, then the least id, stays."""
    order = F.struct(F.expr("int(name <> trim(name))"), "id")
    keyed = lib.person.withColumn("_key", name_key(F.col("name")))
    kept = keyed.groupBy("_key").agg(F.min_by("id", order).alias("_kept"))
    remap = keyed.join(kept, "_key").select(F.col("id").alias("_old"), "_kept")
    cluster = lib.cluster.join(remap, lib.cluster["person_id"] == remap["_old"], "left").withColumn("person_id", F.coalesce("_kept", "person_id")).select(*lib.cluster.columns)
    person = lib.person.join(kept.select(F.col("_kept").alias("id")), "id", "left_semi").withColumn("name", F.trim("name"))
    return lib.with_tables(cluster=cluster, person=person)


def person_named(lib: Library, name: str) -> tuple[Library, int]:
    """The id of the person of that name, made if there is none."""
    name = name.strip()
    if not name:
        raise ValueError("a person needs a name")
    found = lib.person.where(name_key(F.col("name")) == name_key(F.lit(name))).agg(F.min("id")).first()[0]
    if found is not None:
        return lib, found
    fresh = next_id(lib.person)
    row = lib.person.sparkSession.createDataFrame([(fresh, name)], "id bigint, name string")
    return lib.with_tables(person=lib.person.select("id", "name").unionByName(row)), fresh


def assign_cluster(lib: Library, cluster_id: int, name: str) -> Library:
    """Give a cluster to a person; its row is made if only faces know it. Both people become dirty."""
    if lib.face.where(F.col("cluster_id") == cluster_id).limit(1).count() == 0:
        raise LookupError(f"cluster {cluster_id} has no faces")
    before = lib.cluster.where(F.col("id") == cluster_id).select("person_id")
    lib, person = person_named(lib, name)
    row = lib.cluster.sparkSession.createDataFrame([(cluster_id, None, person)], "id bigint, label string, person_id bigint")
    cluster = insert_missing(lib.cluster.select("id", "label", "person_id"), row, "id")
    cluster = cluster.withColumn("person_id", F.when(F.col("id") == cluster_id, person).otherwise(F.col("person_id")).cast("bigint"))
    return mark_dirty(lib.with_tables(cluster=cluster), before.unionByName(row.select("person_id")))


def _set(face: DataFrame, chosen: Column, **values) -> DataFrame:
    kinds = dict(face.dtypes)
    return face.withColumns({c: F.when(chosen, v).otherwise(F.col(c)).cast(kinds[c]) for c, v in values.items()})


def create_cluster(lib: Library, face_ids: Sequence[int] | DataFrame, label: str | None = None, person_id: int | None = None) -> tuple[Library, int]:
    """A new cluster of the faces, all of which must exist."""
    ids = id_table(lib, face_ids)
    if ids.join(lib.face.select("id"), "id", "left_anti").limit(1).count():
        raise LookupError("some faces don't exist")
    fresh = max(next_id(lib.cluster), (lib.face.agg(F.max("cluster_id")).first()[0] or 0) + 1)
    row = lib.cluster.sparkSession.createDataFrame([(fresh, label, person_id)], "id bigint, label string, person_id bigint")
    face = _set(_marked(lib.face, ids), F.col("_in"), cluster_id=F.lit(fresh), review_status=F.lit("active")).select(*lib.face.columns)
    out = lib.with_tables(face=face, cluster=lib.cluster.select("id", "label", "person_id").unionByName(row))
    return drop_empty_clusters(out), fresh


def assign_faces(lib: Library, face_ids: Sequence[int] | DataFrame, name: str) -> Library:
    """Give faces to a person: their cluster if they are exactly its active faces, else a new one. Whoever had some of them becomes dirty too."""
    ids = id_table(lib, face_ids)
    before = owners_of(lib, ids)
    active = _marked(lib.face.where("review_status = 'active' and cluster_id is not null"), ids)
    whole = active.groupBy("cluster_id").agg(F.count_if("_in").alias("n"), F.count("*").alias("all")).where((F.col("n") == F.col("all")) & (F.col("n") == ids.count()))
    reuse = whole.agg(F.min("cluster_id")).first()[0]
    if reuse is None:
        lib, reuse = create_cluster(lib, ids)
    return mark_dirty(assign_cluster(lib, reuse, name), before)


def remove_faces(lib: Library, cluster_id: int, face_ids: Sequence[int] | DataFrame, vectors: DataFrame | None = None, threshold: float = 0.5) -> Library:
    """Take faces out of a cluster into the inbox; with ``vectors`` (id, vec) they are grouped there at once, but never into the cluster that they left."""
    ids = id_table(lib, face_ids).join(lib.face.where(F.col("cluster_id") == cluster_id).select("id"), "id", "left_semi")
    if not ids.limit(1).count():
        raise LookupError("no chosen face is in this cluster")
    owner = owners_of(lib, ids)
    out = lib.with_tables(face=_set(_marked(lib.face, ids), F.col("_in"), cluster_id=F.lit(None)).select(*lib.face.columns))
    if vectors is not None:
        source = lib.cluster.sparkSession.createDataFrame([(cluster_id,)], "cluster_id bigint")
        out, _ = recluster(out, vectors, threshold, ids, source)
    return mark_dirty(drop_empty_clusters(out), owner)


def claim_faces(lib: Library, claims: DataFrame) -> Library:
    """Set clusters (id, cluster_id) only of faces that are still active and loose."""
    free = lib.face.where("review_status = 'active' and cluster_id is null").select("id")
    ok = claims.join(free, "id", "left_semi").select("id", F.col("cluster_id").alias("_new"))
    face = lib.face.join(ok, "id", "left").withColumn("cluster_id", F.coalesce("_new", "cluster_id")).select(*lib.face.columns)
    rows = ok.select(F.col("_new").alias("id"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("bigint").alias("person_id"))
    return lib.with_tables(face=face, cluster=insert_missing(lib.cluster.select("id", "label", "person_id"), rows, "id"))


def archive_faces(lib: Library, face_ids: Sequence[int] | DataFrame, status: str) -> Library:
    """Archive faces: a cluster chosen whole keeps its id and loses its person, a part is split off under a new id, loose faces share one. Their people become dirty."""
    if status not in FACE_STATUSES[1:]:
        raise ValueError(f"unknown review status {status}")
    ids = id_table(lib, face_ids)
    face = _marked(lib.face, ids)
    parts = face.groupBy("cluster_id").agg(F.count_if("_in").alias("n"), F.count("*").alias("all")).where("n > 0")
    base = max(next_id(lib.cluster), (lib.face.agg(F.max("cluster_id")).first()[0] or 0) + 1)
    split = parts.where("cluster_id is null or n < all")
    # at most one row for each cluster chosen from
    fresh = split.withColumn("_new", F.expr(f"{base} - 1 + row_number() over (order by cluster_id)").cast("bigint")).select(F.col("cluster_id").alias("_old"), "_new")
    moved = face.join(fresh, F.col("_in") & face["cluster_id"].eqNullSafe(fresh["_old"]), "left")
    out_face = moved.withColumn("cluster_id", F.coalesce("_new", "cluster_id")).withColumn("review_status", F.when(F.col("_in"), status).otherwise(F.col("review_status"))).select(*lib.face.columns)
    whole = parts.where("cluster_id is not null and n = all").select(F.col("cluster_id").alias("id"), F.lit(True).alias("_whole"))
    cluster = lib.cluster.join(whole, "id", "left").withColumn("person_id", F.when(F.col("_whole"), None).otherwise(F.col("person_id"))).select("id", "label", "person_id")
    rows = fresh.select(F.col("_new").alias("id"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("bigint").alias("person_id"))
    return mark_dirty(drop_empty_clusters(lib.with_tables(face=out_face, cluster=cluster.unionByName(rows))), owners_of(lib, ids))


def restore_faces(lib: Library, face_ids: Sequence[int] | DataFrame, vectors: DataFrame | None = None, threshold: float = 0.5) -> Library:
    """Archived faces become active and loose; with ``vectors`` (id, vec) they are grouped among nobody's at once. Their people become dirty."""
    ids = id_table(lib, face_ids)
    out = lib.with_tables(face=_set(_marked(lib.face, ids), F.col("_in"), cluster_id=F.lit(None), review_status=F.lit("active")).select(*lib.face.columns))
    if vectors is not None:
        out, _ = recluster(out, vectors, threshold, ids)
    return mark_dirty(drop_empty_clusters(out), owners_of(lib, ids))


def rename_cluster(lib: Library, cluster_id: int, label: str | None) -> Library:
    return lib.with_tables(cluster=lib.cluster.withColumn("label", F.when(F.col("id") == cluster_id, F.lit(label)).otherwise(F.col("label"))))


def rename_person(lib: Library, person_id: int, name: str) -> Library:
    """Rename a person; one who has that name already takes over the clusters, and both become dirty."""
    other = lib.person.where((name_key(F.col("name")) == name_key(F.lit(name))) & (F.col("id") != person_id)).agg(F.min("id")).first()[0]
    if other is None:
        return lib.with_tables(person=lib.person.withColumn("name", F.when(F.col("id") == person_id, F.lit(name.strip())).otherwise(F.col("name"))))
    cluster = lib.cluster.withColumn("person_id", F.when(F.col("person_id") == person_id, other).otherwise(F.col("person_id")).cast("bigint"))
    both = lib.person.sparkSession.createDataFrame([(person_id,), (other,)], "person_id bigint")
    return mark_dirty(lib.with_tables(cluster=cluster, person=lib.person.where(F.col("id") != person_id)), both)


def delete_person(lib: Library, person_id: int, target: str = "unassigned", vectors: DataFrame | None = None, threshold: float = 0.5) -> Library:
    """Delete a person; the faces become active and loose, or are archived with their clusters. With ``vectors`` (id, vec) loose ones are grouped among nobody's at once. Nobody's pool is to be rebuilt."""
    if not lib.person.where(F.col("id") == person_id).limit(1).count():
        raise LookupError(f"there is no person {person_id}")
    own = lib.cluster.where(F.col("person_id") == person_id).select(F.col("id").alias("cluster_id"), F.lit(True).alias("_own"))
    face = lib.face.join(own, "cluster_id", "left")
    if target == "unassigned":
        face = face.withColumn("cluster_id", F.when(F.col("_own"), None).otherwise(F.col("cluster_id"))).withColumn("review_status", F.when(F.col("_own"), "active").otherwise(F.col("review_status")))
    elif target in FACE_STATUSES[1:]:
        face = face.withColumn("review_status", F.when(F.col("_own"), target).otherwise(F.col("review_status")))
    else:
        raise ValueError(f"unknown target {target}")
    cluster = lib.cluster.withColumn("person_id", F.when(F.col("person_id") == person_id, None).otherwise(F.col("person_id")))
    out = lib.with_tables(face=face.select(*lib.face.columns), cluster=cluster, person=lib.person.where(F.col("id") != person_id))
    if vectors is not None and target == "unassigned":
        out, _ = recluster(out, vectors, threshold, lib.face.join(own, "cluster_id", "left_semi").select("id"))
    return drop_empty_clusters(mark_dirty(out, lib.person.where("false").select(F.col("id").alias("person_id")).unionByName(lib.person.sparkSession.createDataFrame([(None,)], "person_id bigint"))))


def accept_person_suggestions(lib: Library, accepted: DataFrame) -> Library:
    """Give clusters (cluster_id, person_id) to people, all or none: each must be pending still, and once only."""
    if accepted.groupBy("cluster_id").count().where("count > 1").limit(1).count():
        raise ValueError("a cluster is accepted twice")
    pending = lib.cluster_person_suggestion.where("status = 'pending'")
    if accepted.join(pending, ["cluster_id", "person_id"], "left_anti").limit(1).count():
        raise LookupError("a suggestion is out of date")
    new = accepted.select(F.col("cluster_id").alias("id"), F.col("person_id").alias("_person"))
    cluster = lib.cluster.join(new, "id", "left").withColumn("person_id", F.coalesce("_person", "person_id")).select(*lib.cluster.columns)
    out = lib.with_tables(cluster=cluster, cluster_person_suggestion=lib.cluster_person_suggestion.join(accepted.select("cluster_id"), "cluster_id", "left_anti"))
    return mark_dirty(out, accepted.select("person_id"))


def accept_review_suggestions(lib: Library, cluster_ids: Sequence[int] | DataFrame) -> Library:
    """Archive the active faces of clusters (a list, or a table of cluster_id) as their pending suggestions say, all or none. Nobody's pool becomes dirty, and whoever had them."""
    spark = lib.cluster.sparkSession
    wanted = cluster_ids if isinstance(cluster_ids, DataFrame) else spark.createDataFrame([(int(i),) for i in cluster_ids], "cluster_id bigint")
    wanted = wanted.select("cluster_id").distinct()
    pending = lib.cluster_review_suggestion.where("status = 'pending'").join(wanted, "cluster_id", "left_semi").select("cluster_id", F.col("review_status").alias("_new"))
    if wanted.join(pending, "cluster_id", "left_anti").limit(1).count():
        raise LookupError("a suggestion is out of date")
    face = lib.face.join(pending, "cluster_id", "left")
    hit = F.col("_new").isNotNull() & (F.col("review_status") == "active")
    face = face.withColumn("cluster_id", F.when(hit, None).otherwise(F.col("cluster_id"))).withColumn("review_status", F.when(hit, F.col("_new")).otherwise(F.col("review_status")))
    left = lib.cluster_review_suggestion.join(wanted, "cluster_id", "left_anti")
    owners = lib.cluster.join(wanted, lib.cluster["id"] == wanted["cluster_id"], "left_semi").select("person_id")
    return mark_dirty(drop_empty_clusters(lib.with_tables(face=face.select(*lib.face.columns), cluster_review_suggestion=left)), owners)


def dismiss_suggestion(suggestions: DataFrame, cluster_id: int) -> DataFrame:
    hit = (F.col("cluster_id") == cluster_id) & (F.col("status") == "pending")
    return suggestions.withColumn("status", F.when(hit, "dismissed").otherwise(F.col("status")))


def refreshed_suggestions(old: DataFrame, new: DataFrame, cluster: DataFrame) -> DataFrame:
    """New pending suggestions, and old dismissed ones of clusters that live and have no person; a dismissed cluster gets no new one."""
    free = cluster.where("person_id is null").select(F.col("id").alias("cluster_id"))
    kept = old.where("status = 'dismissed'").join(free, "cluster_id", "left_semi")
    return kept.unionByName(new.join(kept.select("cluster_id"), "cluster_id", "left_anti"), allowMissingColumns=True)


def delete_image(lib: Library, image_id: int) -> Library:
    """An image goes with its locations and faces."""
    gone = lambda df, c: df.where(F.col(c) != image_id)
    return drop_empty_clusters(lib.with_tables(image=gone(lib.image, "id"), image_location=gone(lib.image_location, "image_id"), face=gone(lib.face, "image_id")))


def canonical_paths(lib: Library) -> DataFrame:
    """Images with the path, directory and name of their least location, compared without case."""
    best = lib.image_location.groupBy("image_id").agg(F.min_by(F.struct("path", "directory", "filename"), F.struct(F.lower("path"), "path")).alias("_l"))
    rest = [c for c in lib.image.columns if c not in ("path", "directory", "filename")]
    return lib.image.select(*rest).join(best, lib.image["id"] == best["image_id"], "left").select(*rest, "_l.path", "_l.directory", "_l.filename")


def remove_missing_paths(lib: Library, missing: DataFrame) -> tuple[Library, DataFrame]:
    """Locations whose path is missing go, images without one go too, others point to their next; also the ids of lost faces."""
    places = lib.image_location.join(missing.select("path"), "path", "left_anti").select(*lib.image_location.columns)
    image = lib.image.join(places.select(F.col("image_id").alias("id")), "id", "left_semi")
    alive = image.select(F.col("id").alias("image_id"))
    lost = lib.face.join(alive, "image_id", "left_anti").select("id")
    out = lib.with_tables(image_location=places, image=image, face=lib.face.join(alive, "image_id", "left_semi").select(*lib.face.columns))
    return drop_empty_clusters(out.with_tables(image=canonical_paths(out))), lost


def prune_stale_locations(lib: Library, seen: DataFrame, verified: DataFrame) -> Library:
    """Of images whose content was seen now (content_hash), locations not among the verified paths go."""
    images = lib.image.join(seen.select("content_hash"), "content_hash", "left_semi").select(F.col("id").alias("image_id"))
    stale = lib.image_location.join(images, "image_id", "left_semi").join(verified.select("path"), "path", "left_anti").select("path")
    return remove_missing_paths(lib, stale)[0]


def merge_duplicate_images(lib: Library) -> Library:
    """Images of one content become one: a processed one, then the least id, takes the locations and keeps its own faces."""
    order = F.struct(F.expr("int(processed_at is null)"), "id")
    kept = lib.image.where("content_hash is not null").groupBy("content_hash").agg(F.min_by("id", order).alias("_kept"))
    remap = lib.image.join(kept, "content_hash").select(F.col("id").alias("_old"), "_kept").where("_old <> _kept")
    places = lib.image_location.join(remap, lib.image_location["image_id"] == remap["_old"], "left").withColumn("image_id", F.coalesce("_kept", "image_id")).select(*lib.image_location.columns).dropDuplicates(["path"])
    gone = remap.select(F.col("_old").alias("id"))
    face = lib.face.join(remap.select(F.col("_old").alias("image_id")), "image_id", "left_anti").select(*lib.face.columns)
    return drop_empty_clusters(lib.with_tables(image=lib.image.join(gone, "id", "left_anti"), image_location=places, face=face))


def clear_dirty(lib: Library, persons: DataFrame) -> Library:
    """Take people (null: nobody's pool) off the list of groups to be rebuilt."""
    done = persons.select(F.coalesce(F.col("person_id").cast("bigint"), F.lit(-1)).alias("person_id")).distinct()
    held = lib.recluster_dirty_person
    return lib if held is None else lib.with_tables(recluster_dirty_person=held.join(done, "person_id", "left_anti"))


def dirty_scopes(lib: Library) -> DataFrame:
    """(person_id, face_count) of the groups to be rebuilt that still have active faces; -1 is nobody's pool."""
    owner = lib.cluster.select(F.col("id").alias("cluster_id"), "person_id")
    faces = lib.face.where("review_status = 'active'").join(owner, "cluster_id", "left").groupBy(F.coalesce("person_id", F.lit(-1)).alias("person_id")).agg(F.count("*").alias("face_count"))
    return faces.join(lib.recluster_dirty_person, "person_id", "left_semi")


def recluster_inbox(lib: Library, vectors: DataFrame, threshold: float, cohesion: float | None = None, outlier: float | None = None) -> Library:
    """Group all active loose faces among themselves and with nobody's clusters (``reclustering.recluster``); nobody's pool is done then."""
    out, _ = recluster(lib, vectors, threshold, cohesion=cohesion, outlier=outlier)
    return clear_dirty(out, lib.person.sparkSession.createDataFrame([(None,)], "person_id bigint"))


def rebuild_pool(lib: Library, vectors: DataFrame, threshold: float, cohesion: float | None = None, outlier: float | None = None) -> Library:
    """Nobody's active faces are set loose and grouped anew; faces of people and archived ones stay."""
    nobody = lib.cluster.where("person_id is null").select(F.col("id").alias("cluster_id"), F.lit(True).alias("_nobody"))
    face = lib.face.join(nobody, "cluster_id", "left")
    loose = F.coalesce("_nobody", F.lit(False)) & (F.col("review_status") == "active")
    face = face.withColumn("cluster_id", F.when(loose, None).otherwise(F.col("cluster_id"))).select(*lib.face.columns)
    return recluster_inbox(drop_empty_clusters(lib.with_tables(face=face)), vectors, threshold, cohesion, outlier)
