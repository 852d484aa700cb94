"""Grouping detached faces anew, pool by pool.

A face joins others only where some face is within the threshold, so the graph of faces
within it falls into components that no decision crosses: known clusters of nobody hold
their faces together, and what consolidation looks at is within its own, slightly wider,
limit. Components are pools of their own, and pools are what tasks share out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.library import Library
from shoebox.operators import clustering, vectors
from shoebox.operators.components import components, local_roots
from shoebox.storage import numbered, settled


def linked(targets: DataFrame, references: DataFrame, limit: float) -> DataFrame:
    """Edges (a, b) that hold together what pairs of a target and a reference within ``limit`` do: of each pair of blocks a star for each of its components."""

    def work(left, right):
        ids, at = np.unique(np.r_[left[0], right[0]], return_inverse=True)
        i, j = np.nonzero(1 - left[1] @ right[1].T <= limit)
        root = local_roots(len(ids), at[: len(left[0])][i], at[len(left[0]) :][j])
        far = np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[far], "b": ids[root[far]]})

    return vectors.block_pairs(targets, references, work, "a bigint, b bigint", block=2048)


def pools(targets: DataFrame, known: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``targets`` (id, vec) and ``known`` (id, vec, cluster_id) with the pool, group_id, that each is in; known faces in pools without a target are left out."""
    limit = clustering.relaxed(threshold)
    edges = linked(targets.select("id", "vec"), targets.select("id", "vec").unionByName(known.select("id", "vec")), limit)
    whole = known.groupBy("cluster_id").agg(F.min("id").alias("b"))
    stars = known.join(whole, "cluster_id").select(F.col("id").alias("a"), "b")
    roots = components(edges.unionByName(stars))
    placed = lambda df: df.join(roots, "id", "left").withColumn("group_id", F.coalesce("root", "id")).drop("root")
    targets, known = settled(placed(targets)), placed(known)
    return targets, settled(known.join(targets.select("group_id").distinct(), "group_id", "left_semi"))


def regroup_loose(targets: DataFrame, known: DataFrame, threshold: float, cohesion: float | None = None, outlier: float | None = None) -> DataFrame:
    """(id, cluster_id): a known cluster for each target face, or a number below zero that new ones share.

    Targets, by id, join the known clusters of their pool or one another; small new
    clusters are consolidated and wide ones split, known faces staying where they are.
    A new cluster is named by its least face: -1 - id.
    """
    new, held = pools(targets, known, threshold)
    first = clustering.assign_incrementally(new, held, threshold)
    there = held.select("group_id", "cluster_id").distinct().withColumn("_known", F.lit(True))
    first = first.join(there, ["group_id", "cluster_id"], "left").withColumn("_least", F.expr("min(id) over (partition by group_id, cluster_id)"))
    named = first.select("id", "group_id", F.when(F.col("_known"), F.col("cluster_id")).otherwise(-1 - F.col("_least")).alias("cluster_id"))
    faces = named.join(new.select("id", "vec"), "id").withColumn("movable", F.lit(True))
    faces = settled(faces.unionByName(held.select("id", "group_id", "cluster_id", "vec").withColumn("movable", F.lit(False))))
    merged = clustering.consolidate(faces, threshold, group="group_id").join(faces.select("id", "vec", "movable"), "id")
    parts = clustering.split_clusters(settled(merged), threshold if cohesion is None else cohesion, outlier)
    parts = parts.join(faces.where("movable").select("id"), "id", "left_semi")
    least = F.expr("min(id) over (partition by cluster_id, part)")
    return parts.withColumn("_least", least).select("id", F.when((F.col("part") == 0) & (F.col("cluster_id") > 0), F.col("cluster_id")).otherwise(-1 - F.col("_least")).alias("cluster_id"))


def recluster(lib: Library, vectors_of: DataFrame, threshold: float, faces: DataFrame | None = None, excluded: DataFrame | None = None, cohesion: float | None = None, outlier: float | None = None) -> tuple[Library, DataFrame]:
    """The library with its active loose faces in clusters of nobody, and the claims (id, cluster_id) made.

    ``vectors_of`` has id and vec; ``faces`` (id) narrows the loose faces, ``excluded``
    (cluster_id) are clusters that none of them may join. Faces of people and archived ones
    take no part. A face without a vector gets a cluster of its own. New clusters are
    numbered after all others, by their least face. Clusters without faces go.
    """
    from shoebox.operators.mutations import claim_faces, drop_empty_clusters, next_id

    loose = lib.face.where("review_status = 'active' and cluster_id is null").select("id")
    if faces is not None:
        loose = loose.join(faces.select("id"), "id", "left_semi")
    nobody = lib.cluster.where("person_id is null").select(F.col("id").alias("cluster_id"))
    if excluded is not None:
        nobody = nobody.join(excluded.select("cluster_id"), "cluster_id", "left_anti")
    loose = settled(loose)
    known = lib.face.where("review_status = 'active'").join(nobody, "cluster_id", "left_semi").select("id", "cluster_id").join(vectors_of.select("id", "vec"), "id")
    seen = loose.join(vectors_of.select("id", "vec"), "id")
    found = regroup_loose(seen, settled(known), threshold, cohesion, outlier)
    blind = loose.join(seen.select("id"), "id", "left_anti").select("id", (-1 - F.col("id")).alias("cluster_id"))
    found = settled(found.unionByName(blind))
    fresh = max(next_id(lib.cluster), (lib.face.agg(F.max("cluster_id")).first()[0] or 0) + 1)
    made = found.where("cluster_id < 0").groupBy("cluster_id").agg(F.min("id").alias("least"))
    numbers = numbered(made, "least").select("cluster_id", (F.col("n") + fresh).alias("_new"))
    claims = settled(found.join(numbers, "cluster_id", "left").select("id", F.coalesce("_new", "cluster_id").alias("cluster_id")))
    return drop_empty_clusters(claim_faces(lib, claims)), claims
