"""Thresholds from labelled faces, and suggestions of people and review states."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.functions.vector import clipped, distance, normalized
from shoebox.operators import vectors
from shoebox.storage import settled


def tune_grid(pairs: DataFrame) -> DataFrame:
    """(threshold, same, other, balanced) over 0, 0.01 ... 1 from (person_id, pos, neg): distances of each face to its
    own person (null: none) and to the nearest other. Rates are means over people.

    Faces are counted by person and by the first threshold that reaches them, so what meets
    the thresholds are a person's hundred counts.
    """

    def reached(c: str) -> Column:
        """The first threshold, in hundredths, that is no less; 101 beyond the last."""
        near = F.ceil(F.col(c) * 100).cast("int")
        exact = F.when(F.col(c) <= (near - 1) / 100.0, near - 1).when(F.col(c) <= near / 100.0, near).otherwise(near + 1)
        return F.when(F.col(c).isNotNull(), F.least(F.greatest(exact, F.lit(0)), F.lit(101)))

    counts = pairs.select("person_id", reached("pos").alias("p"), reached("neg").alias("q"))
    each = counts.groupBy("person_id", "p", "q").agg(F.count("*").alias("n")).groupBy("person_id").agg(F.collect_list(F.struct("p", "q", "n")).alias("held"))
    total = lambda keep: F.aggregate(F.filter("held", keep), F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    grid = F.explode(F.sequence(F.lit(0), F.lit(100))).alias("g")
    rates = each.select("person_id", "held", grid)
    share = lambda hit, there: F.when(there > 0, hit / there)
    rates = rates.select(
        "g", share(total(lambda x: x["p"] <= F.col("g")), total(lambda x: x["p"].isNotNull())).alias("same"),
        share(total(lambda x: x["q"] > F.col("g")), total(lambda x: x["q"].isNotNull())).alias("other"),
    )
    done = rates.groupBy("g").agg(F.avg("same").alias("same"), F.avg("other").alias("other"))
    return done.select((F.col("g") / 100.0).alias("threshold"), "same", "other", ((F.col("same") + F.col("other")) / 2).alias("balanced"))


def best_threshold(grid: DataFrame) -> DataFrame:
    """The row of the best balance, then of the better other and same rates, then of the least threshold."""
    key = F.struct(F.round("balanced", 12), F.round("other", 12), F.round("same", 12), -F.col("threshold"))
    return grid.agg(F.max_by(F.struct("threshold", "same", "other", "balanced"), key).alias("r")).select("r.threshold", *(F.round(f"r.{c}", 4).alias(c) for c in ("same", "other", "balanced")))


def group_distances(faces: DataFrame, group: str) -> DataFrame:
    """(id, group, distance): how far each face is from each group's faces but itself: the largest of the nearest, the centroid of them and, where they are three or more, the second nearest."""
    two = vectors.nearest_two(faces, faces.select("id", group, "vec"), group)
    centre = vectors.centroids(faces, group).select(F.col(group).alias("_group"), "sum", "n")
    mine = faces.select("id", F.col(group).alias("_own"), "vec")
    met = two.join(mine, "id").join(centre, F.col(group) == F.col("_group"))
    own = F.col("_own").eqNullSafe(F.col(group))
    rest = F.when(own, F.zip_with("sum", "vec", lambda s, x: s - x)).otherwise(F.col("sum"))
    n = F.col("n") - own.cast("int")
    far = F.greatest("nearest", distance(F.col("vec"), normalized(rest)), F.when(n >= 3, F.col("second")))
    return met.where(n > 0).select("id", group, clipped(far, 0.0, 2.0).alias("distance"))


def own_distance(faces: DataFrame, group: str) -> DataFrame:
    """(id, distance): how far each face is from the others of its own group, as ``group_distances`` has it; faces alone in their group are left out."""
    two = vectors.nearest_two_within(faces, group)
    centre = vectors.centroids(faces, group)
    met = two.join(faces.select("id", group, "vec"), "id").join(centre.select(group, "sum", "n"), group)
    rest = F.zip_with("sum", "vec", lambda s, x: s - x)
    far = F.greatest("nearest", distance(F.col("vec"), normalized(rest)), F.when(F.col("n") >= 4, F.col("second")))
    return met.select("id", clipped(far, 0.0, 2.0).alias("distance"))


def nearest_other(faces: DataFrame, group: str) -> DataFrame:
    """(id, distance): the least distance, as ``group_distances`` has it, of each face to a group that isn't its own.

    A group's distance is no less than that of its centroid. So a face looks first at the two
    groups of nearest centroids, and then only at groups whose centroid is no farther than
    what it has found: rows are made for those, not for every face and group.
    """
    named = settled(faces.select(F.col("id"), F.col(group).cast("bigint").alias("g"), "vec"))
    centre = settled(vectors.centroids(named, "g").select("g", "centroid", "n"))
    points = centre.select(F.col("g").alias("id"), F.col("centroid").alias("vec"))

    def first(a, b):
        own, x = a[1][:, 0], a[1][:, 2:]
        d = 1 - x @ b[1].T
        d[own[:, None] == b[0][None, :]] = np.inf
        near = np.argsort(d, axis=1)[:, :2]
        rows = np.repeat(np.arange(len(x)), near.shape[1])
        far = d[rows, near.ravel()]
        return pd.DataFrame({"id": a[0][rows], "g": b[0][near.ravel()], "far": far})[np.isfinite(far)]

    def within(a, b):
        own, most, x = a[1][:, 0], a[1][:, 1], a[1][:, 2:]
        d = 1 - x @ b[1].T
        i, j = np.nonzero((d <= most[:, None] + 1e-9) & (own[:, None] != b[0][None, :]))
        return pd.DataFrame({"id": a[0][i], "g": b[0][j], "far": d[i, j]})

    def asked(most: Column, rows: DataFrame) -> DataFrame:
        return rows.select("id", F.concat(F.array(F.col("g").cast("double"), most), "vec").alias("vec"))

    def exact(wanted: DataFrame) -> DataFrame:
        """(id, g, distance) of faces and groups: the nearest two faces of the group, met by group and block."""
        two = vectors.nearest_two_of(wanted.join(named.select("id", "vec"), "id"), named)
        met = two.join(wanted, ["id", "g"]).join(centre.select("g", "n"), "g")
        return met.select("id", clipped(F.greatest("nearest", "far", F.when(F.col("n") >= 3, F.col("second"))), 0.0, 2.0).alias("distance"))

    schema = "id bigint, g bigint, far double"
    near = vectors.block_pairs(asked(F.lit(0.0), named), points, first, schema)
    near = settled(near.withColumn("_r", F.expr("row_number() over (partition by id order by far, g)")).where("_r <= 2").drop("_r"))
    found = settled(exact(near).groupBy("id").agg(F.min("distance").alias("distance")))
    rest = vectors.block_pairs(asked(F.col("distance"), named.join(found, "id")), points, within, schema).join(near, ["id", "g"], "left_anti")
    return found.unionByName(exact(settled(rest))).groupBy("id").agg(F.min("distance").alias("distance"))


def person_distances(faces: DataFrame) -> DataFrame:
    """(id, person_id, pos, neg): each named face's distance to its own appearance, and the least to another person.

    The own appearance is the face's cluster, or where it is alone there, its person, without
    the face itself; null where there is none. Distances are those of ``group_distances``.
    """
    if "cluster_id" not in faces.columns:  # then a person has one appearance
        faces = faces.withColumn("cluster_id", F.col("person_id"))
    named = settled(faces.where("person_id is not null").select("id", "person_id", "cluster_id", "vec"))
    by_person = own_distance(named, "person_id").withColumnRenamed("distance", "by_person")
    by_cluster = own_distance(named.where("cluster_id is not null"), "cluster_id").withColumnRenamed("distance", "by_cluster")
    other = nearest_other(named, "person_id").withColumnRenamed("distance", "neg")
    held = named.select("id", "person_id").join(by_cluster, "id", "left").join(by_person, "id", "left").join(other, "id", "left")
    return held.select("id", "person_id", F.coalesce("by_cluster", "by_person").alias("pos"), "neg")


def cohesion(sample: DataFrame, unknown: DataFrame, threshold: float) -> DataFrame:
    """(cohesion, stable): how wide clusters are, from the sampled people's and from steady clusters of nobody, within 0.85 of the threshold and itself.

    ``sample`` and ``unknown`` have cluster_id and vec; of nobody's clusters those of 5 to 1000 faces that fit the threshold count.
    """
    wide = vectors.radii(sample, "cluster_id").where("n >= 3").agg(F.percentile("radius", 0.75).alias("observed"))
    steady = vectors.radii(unknown, "cluster_id").where((F.col("n") >= 5) & (F.col("n") <= 1000) & (F.col("radius") <= threshold)).agg(F.max("radius").alias("floor"), F.count("*").alias("stable"))
    first = F.coalesce(clipped(F.col("observed"), 0.85 * threshold, threshold), F.lit(threshold))
    # both are one row
    return wide.withColumn("_one", F.lit(1)).join(steady.withColumn("_one", F.lit(1)), "_one").select(clipped(F.greatest(first, F.coalesce("floor", first)), 0.85 * threshold, threshold).alias("cohesion"), "stable")


def nearest_pairs(sample: DataFrame) -> DataFrame:
    """(id, pos, neg): the plain nearest distance to the own cluster, or else the own person, and to any other person, of the faces that have both."""
    own = sample.select("id", F.col("person_id").alias("_person"), F.col("cluster_id").alias("_cluster"))
    people = vectors.nearest_two(sample, sample.select("id", "person_id", "vec"), "person_id").join(own, "id")
    looks = vectors.nearest_two(sample, sample.select("id", "cluster_id", "vec"), "cluster_id").join(own, "id").where(F.col("cluster_id") == F.col("_cluster")).select("id", F.col("nearest").alias("near_cluster"))
    per = people.groupBy("id").agg(F.min(F.when(F.col("person_id") == F.col("_person"), F.col("nearest"))).alias("near_person"), F.min(F.when(F.col("person_id") != F.col("_person"), F.col("nearest"))).alias("neg"))
    return per.join(looks, "id", "left").select("id", F.coalesce("near_cluster", "near_person").alias("pos"), "neg").where("pos is not null and neg is not null")


def auto_tune(faces: DataFrame) -> DataFrame:
    """One row: threshold, same, other, balanced, cohesion, anchor, ambiguity, support_ratio, outlier, stable, sampled: the profile that named faces suggest.

    ``faces`` are active ones with id, person_id (null: nobody), cluster_id and vec. A
    balanced sample of at most 4000 named faces is tuned on. Raises ValueError where there
    are fewer than three, of one person, or no two of any.
    """
    sample = vectors.balanced_sample(faces.where("person_id is not null and cluster_id is not null")).select("id", "person_id", "cluster_id", "vec")
    n, people, most = sample.groupBy("person_id").count().agg(F.sum("count"), F.count("*"), F.max("count")).first()
    if (n or 0) < 3 or people < 2 or most < 2:
        raise ValueError("tuning needs three faces of two people, two of them of one")
    best = best_threshold(tune_grid(person_distances(sample))).first()
    t = float(best["threshold"])
    wide = cohesion(sample, faces.where("person_id is null and cluster_id is not null"), t)
    limits = profile_quantiles(nearest_pairs(sample), t)
    held = wide.withColumn("_one", F.lit(1)).join(limits.withColumn("_one", F.lit(1)), "_one")
    number = lambda x: F.lit(float(x))
    return held.select(
        number(t).alias("threshold"), *(number(best[c]).alias(c) for c in ("same", "other", "balanced")), "cohesion", "anchor", "ambiguity", number(0.80).alias("support_ratio"),
        F.least(F.lit(1.0), F.greatest(number(t), 1.12 * F.col("cohesion"))).alias("outlier"), "stable", F.lit(n).cast("bigint").alias("sampled"),
    )


def profile_quantiles(pairs: DataFrame, threshold: float) -> DataFrame:
    """Ambiguity and anchor limits from the quantiles of (pos, neg); defaults where there are no pairs."""
    q = pairs.agg(F.percentile("pos", 0.75).alias("p75"), F.percentile("neg", 0.01).alias("n01"), F.percentile(F.col("neg") - F.col("pos"), 0.10).alias("m10"))
    ambiguity = F.coalesce(clipped(0.5 * F.col("m10"), 0.055, 0.18), F.lit(max(0.055, 0.09 * threshold)))
    anchor = F.least(F.greatest(F.least(F.col("n01") - F.col("ambiguity"), F.lit(0.8 * threshold)), F.greatest(F.lit(0.18), F.col("p75"))), F.lit(0.48))
    return q.withColumn("ambiguity", ambiguity).select("ambiguity", F.coalesce(anchor, F.lit(min(0.48, 0.7 * threshold))).alias("anchor"))


def person_confidence(ratio: Column, median: Column, margin: Column, limit: float) -> Column:
    return clipped(0.40 * ratio + 0.25 * clipped((limit - median) / max(0.12, limit - 0.18), 0.0, 1.0) + 0.35 * clipped(margin / 0.16, 0.0, 1.0), 0.0, 1.0)


def person_suggestions(targets: DataFrame, prototypes: DataFrame, limit: float, ambiguity: float, support: float = 0.80, least: int = 3) -> DataFrame:
    """(cluster_id, person_id, support_count, face_count, support_ratio, best_distance, runner_up_margin, confidence, peel, recommended).

    ``targets`` are faces (id, cluster_id, vec) of clusters without a person, ``prototypes``
    (person_id, vec) stand for people. A face anchors its nearest person within the limit and
    ahead of the next; with one person alone the limit is tighter. A cluster whose anchors
    name one person goes to it whole; a mixed one is peeled: each person that has enough
    anchors is offered those faces alone. best_distance is the median of a proposal's anchors.
    """
    keyed = prototypes.withColumn("id", F.xxhash64("person_id", F.col("vec").cast("string")))
    near = vectors.nearest_reference(targets, keyed, "person_id")
    best = vectors.best_and_runner_up(near, "person_id")
    single = F.col("margin").isNull()
    best = best.withColumn("anchors", F.when(single, F.col("best_distance") <= min(limit, 0.34)).otherwise((F.col("best_distance") <= limit) & (F.col("margin") >= ambiguity)))
    best = best.withColumn("margin", F.coalesce("margin", F.lit(0.12)))
    placed = targets.select("id", "cluster_id").join(best, "id")
    sizes = targets.groupBy("cluster_id").agg(F.count("*").alias("face_count"))
    per = placed.where("anchors").groupBy("cluster_id", F.col("best").alias("person_id")).agg(
        F.count("*").alias("support_count"), F.median("best_distance").alias("best_distance"), F.median("margin").alias("runner_up_margin")
    ).join(sizes, "cluster_id")
    per = per.withColumn("qualified", F.expr(f"count_if(support_count >= {least}) over (partition by cluster_id)"))
    per = per.withColumn("place", F.expr("row_number() over (partition by cluster_id order by support_count desc, person_id)"))
    ratio = F.col("support_count") / F.col("face_count")
    peel = (F.col("qualified") > 1) | (ratio < support)
    per = per.where((F.col("support_count") >= least) & (peel | (F.col("place") == 1)))
    per = per.withColumn("peel", peel).withColumn("support_ratio", F.when(peel, 1.0).otherwise(ratio)).withColumn("face_count", F.when(peel, F.col("support_count")).otherwise(F.col("face_count")))
    per = per.withColumn("confidence", person_confidence(F.col("support_ratio"), F.col("best_distance"), F.col("runner_up_margin"), limit))
    return per.select("cluster_id", "person_id", "support_count", "face_count", "support_ratio", "best_distance", "runner_up_margin", "confidence", "peel", (F.col("confidence") >= 0.72).alias("recommended"))


def review_suggestions(targets: DataFrame, references: DataFrame, anchor: float, newest: int | None = 6000, per_status: int | None = 3000) -> DataFrame:
    """(cluster_id, review_status, support_count, face_count, support_ratio, best_distance, confidence, recommended).

    ``references`` are archived faces (id, status, vec), of which the newest count, ``newest`` in
    all and ``per_status`` of a state; without these limits (None) all do. A cluster
    near enough to archived faces of a state is offered that state, unless two states are close;
    best_distance is the median of the faces within the state's limit.
    """
    limits = {"unknown_person": min(0.42, max(0.28, 0.9 * anchor)), "not_face": 0.30}
    ratios = {"unknown_person": 0.78, "not_face": 0.88}
    code = F.when(F.col("status") == "unknown_person", 1).otherwise(0)
    kept = references if newest is None else references.orderBy(F.desc("id")).limit(newest)
    if per_status is not None:
        kept = kept.withColumn("_r", F.expr("row_number() over (partition by status order by id desc)")).where(F.col("_r") <= per_status)
    near = vectors.nearest_reference(targets, kept.select("id", code.alias("code"), "vec"), "code").join(targets.select("id", "cluster_id"), "id")
    near = near.withColumn("review_status", F.when(F.col("code") == 1, "unknown_person").otherwise("not_face"))
    of = lambda values: F.when(F.col("review_status") == "unknown_person", values["unknown_person"]).otherwise(values["not_face"])
    supported = F.when(F.col("distance") <= of(limits), F.col("distance"))
    per = near.groupBy("cluster_id", "review_status").agg(F.count(supported).alias("support_count"), F.count("*").alias("face_count"), F.median(supported).alias("best_distance")).where("support_count > 0")
    per = per.withColumn("support_ratio", F.col("support_count") / F.col("face_count"))
    fits = ((F.col("support_count") >= 2) & (F.col("support_ratio") >= of(ratios))) | ((F.col("face_count") == 1) & (F.col("best_distance") <= of(limits) - 0.09))
    scale = F.greatest(F.lit(0.12), of(limits) - 0.12)
    per = per.where(fits).withColumn("confidence", clipped(0.62 * F.col("support_ratio") + 0.38 * clipped((of(limits) - F.col("best_distance")) / scale, 0.0, 1.0), 0.0, 1.0))
    per = per.withColumn("place", F.expr("row_number() over (partition by cluster_id order by confidence desc, review_status desc)")).withColumn("next", F.expr("lead(confidence) over (partition by cluster_id order by confidence desc, review_status desc)"))
    chosen = per.where((F.col("place") == 1) & (F.col("next").isNull() | (F.col("confidence") - F.col("next") >= 0.06)))
    return chosen.select("cluster_id", "review_status", "support_count", "face_count", "support_ratio", "best_distance", "confidence", (F.col("confidence") >= 0.80).alias("recommended"))
