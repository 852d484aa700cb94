"""Grouping faces by similarity: consolidation, splitting, prototypes, ordering, assignment.

Consolidation reads only the labels that it was given, so it is joins and aggregates over
neighbour edges. What works within one cluster or one group of new faces runs grouped, a
group a task. Thresholds are cosine distances; vectors have unit length.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.operators import vectors

EPSILON = 1e-12
#: How far consolidation looks beyond the threshold (least, most, share of it) and the lead that it asks for (least, share).
LOOSER, LEAD = (0.02, 0.06, 0.1), (0.02, 0.06)
#: Of splitting: quantile and share of a broad core, widest outlier and nearest parts as shares of the threshold, least distance of parts, rounds.
CORE, BROAD, OUTLIER, APART, LEAST_APART, ROUNDS = 0.95, 0.05, 1.12, 0.12, 0.04, 12
#: Faces for each prototype, and rounds of means.
FACES_A_PROTOTYPE, MEANS = 12, 8


def relaxed(threshold: float) -> float:
    """How far consolidation looks."""
    least, most, share = LOOSER
    return min(1.0, threshold + min(most, max(least, share * threshold)))


def _unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), EPSILON)


def consolidate(faces: DataFrame, threshold: float, neighbours: int = 16, largest_source: int = 2, least_target: int = 3, group: str | None = None) -> DataFrame:
    """(id, cluster_id): clusters of at most ``largest_source`` movable faces join the cluster that all their faces agree on.

    ``faces`` has id, cluster_id, vec and movable. A face votes among its nearest faces of
    clusters of ``least_target`` or more, within a somewhat relaxed threshold; a target
    needs support, most of the votes, and a lead over the next. All decisions read the
    labels as they came, so nothing depends on order. With ``group``, a column within which
    clusters lie, faces look for neighbours in their own group only.
    """
    margin = max(LEAD[0], LEAD[1] * threshold)
    sizes = faces.groupBy("cluster_id").agg(F.count("*").alias("size"), F.bool_and(F.coalesce("movable", F.lit(False))).alias("all_movable"))
    own = [group] if group else []
    sized = faces.select("id", "cluster_id", "vec", *own).join(sizes, "cluster_id")
    movers = sized.where((F.col("size") <= largest_source) & F.col("all_movable"))
    edges = vectors.knn(movers.select("id", "vec", *own), faces.select("id", "vec", *own), neighbours - 1, digits=12, group=group).select("id", "other", "distance")
    target = sized.where(F.col("size") >= least_target).select(F.col("id").alias("other"), F.col("cluster_id").alias("target"))
    near = edges.join(target, "other").where(F.col("distance") <= relaxed(threshold))
    near = near.withColumn("vote", F.expr("row_number() over (partition by id order by distance, other)"))
    # a face has at most ``neighbours`` edges, so the list of a face and target is short
    per = near.groupBy("id", "target").agg(F.array_sort(F.collect_list("distance")).alias("ds"), F.count_if(F.col("vote") <= 5).alias("votes"))
    near_enough = F.element_at("ds", 1) <= threshold
    per = per.withColumn("votes_all", F.expr("sum(votes) over (partition by id)"))
    per = per.where(F.size("ds") >= F.when(near_enough, 2).otherwise(3))
    per = per.withColumn("score", F.aggregate(F.slice("ds", 1, 3), F.lit(0.0), lambda s, x: s + x) / F.least(F.size("ds"), F.lit(3)))
    ranked = per.withColumn("r", F.expr("row_number() over (partition by id order by score, target)")).withColumn("next", F.expr("lead(score) over (partition by id order by score, target)"))
    chosen = ranked.where((F.col("r") == 1) & (F.col("votes") >= 2) & (F.col("votes") >= 0.6 * F.col("votes_all")) & (F.col("next").isNull() | (F.col("next") - F.col("score") >= margin)))
    by_source = movers.select("id", "cluster_id", "size").join(chosen.select("id", "target"), "id").groupBy("cluster_id").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.min("target").alias("lo"), F.max("target").alias("hi"))
    merges = by_source.where("n = size and lo = hi").select("cluster_id", F.col("lo").alias("into"))
    return faces.join(merges, "cluster_id", "left").select("id", F.coalesce("into", "cluster_id").alias("cluster_id"))


def split_labels(x: np.ndarray, threshold: float, outlier: float | None = None) -> np.ndarray:
    """Parts, from 0 in order of first member, of one cluster's vectors: two-means again and again while a part is too wide."""
    x, labels = _unit(x), np.zeros(len(x), int)
    limit = min(1.0, OUTLIER * threshold) if outlier is None else outlier
    queue, top = [0], 0
    while queue:
        label = queue.pop(0)
        own = np.flatnonzero(labels == label)
        if len(own) < 3:
            continue
        part = x[own]
        d = 1 - part @ _unit(part.mean(0))
        broad = (d > limit).sum() >= max(3, math.ceil(BROAD * len(own)))
        if np.quantile(d, CORE) <= threshold and not broad:
            continue
        a = int(d.argmax())
        b = int((1 - part @ part[a]).argmax())
        if a == b:
            continue
        centres, side = part[[a, b]], np.zeros(len(own), int)
        for _ in range(ROUNDS):
            new = (part @ centres.T).argmax(1)
            if (new == side).all() and _ or not 0 < new.sum() < len(own):
                side = new
                break
            side = new
            centres = np.stack([_unit(part[side == k].mean(0)) for k in (0, 1)])
        least = min((side == 0).sum(), (side == 1).sum())
        if least < 3 or 1 - centres[0] @ centres[1] < max(LEAST_APART, APART * threshold):
            continue
        top += 1
        labels[own[side != side[0]]] = top
        queue += [label, top]
    return labels


def split_clusters(faces: DataFrame, threshold: float, outlier: float | None = None) -> DataFrame:
    """(id, cluster_id, part): part 0 keeps the cluster's id; clusters with a face that isn't movable stay whole. ``faces`` as for consolidate."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        whole = len(pdf) < 3 or not pdf["movable"].fillna(False).all()
        parts = np.zeros(len(pdf), int) if whole else split_labels(np.stack(pdf["vec"].to_numpy()), threshold, outlier)
        return pd.DataFrame({"id": pdf["id"], "cluster_id": pdf["cluster_id"], "part": parts})

    return faces.select("id", "cluster_id", "vec", "movable").groupBy("cluster_id").applyInPandas(one, "id bigint, cluster_id bigint, part int")


def select_prototypes(x: np.ndarray, most: int = 3) -> np.ndarray:
    """Up to ``most`` unit vectors that stand for a set: farthest first, then eight rounds of means."""
    x = _unit(x)
    k = min(most, math.ceil(len(x) / FACES_A_PROTOTYPE))
    mean = _unit(x.mean(0))
    if k <= 1:
        return mean[None]
    chosen = [int((x @ mean).argmax())]
    while len(chosen) < k:
        chosen.append(int((1 - x @ x[chosen].T).min(1).argmax()))
    centres = x[chosen]
    for _ in range(MEANS):
        side = (x @ centres.T).argmax(1)
        centres = np.stack([_unit(x[side == j].mean(0)) if (side == j).any() else centres[j] for j in range(k)])
    return centres


def prototypes(faces: DataFrame, most: int = 3) -> DataFrame:
    """(person_id, cluster_id, place, vec) of every person's clusters."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        found = select_prototypes(np.stack(pdf.sort_values("id")["vec"].to_numpy()), most)
        return pd.DataFrame({"person_id": pdf["person_id"].iloc[0], "cluster_id": pdf["cluster_id"].iloc[0], "place": range(len(found)), "vec": list(found)})

    return faces.where("person_id is not null").select("id", "person_id", "cluster_id", "vec").groupBy("person_id", "cluster_id").applyInPandas(one, "person_id bigint, cluster_id bigint, place int, vec array<double>")


def path_order(x: np.ndarray, ids: np.ndarray, neighbours: int = 32) -> list[int]:
    """Rows in a walk from the least typical to the nearest not yet seen; ties by id."""
    x = np.asarray(x, np.float64)
    if x.ndim != 2 or len(x) != len(ids):
        raise ValueError("vectors and ids must be aligned rows")
    if len(x) < 2:
        return list(range(len(x)))
    x = _unit(x)
    at = int(np.lexsort((ids, np.round(x @ _unit(x.mean(0)), 12)))[0])
    left, walk = np.ones(len(x), bool), [at]
    left[at] = False
    while left.any():
        rows = np.flatnonzero(left)
        at = int(rows[np.lexsort((ids[rows], np.round(1 - x[rows] @ x[at], 12)))[0]])
        left[at] = False
        walk.append(at)
    return walk


def similarity_order(faces: DataFrame) -> DataFrame:
    """(cluster_id, id, place): each cluster's faces in similarity order; faces without a vector last, by id."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        there = pdf["vec"].notna()
        good, rest = pdf[there], pdf[~there]
        walk = path_order(np.stack(good["vec"].to_numpy()), good["id"].to_numpy()) if len(good) else []
        ids = [*good["id"].to_numpy()[walk], *rest["id"]]
        return pd.DataFrame({"cluster_id": pdf["cluster_id"].iloc[0], "id": ids, "place": range(len(ids))})

    return faces.select("id", "cluster_id", "vec").groupBy("cluster_id").applyInPandas(one, "cluster_id bigint, id bigint, place int")


def nearest_rows(d: np.ndarray, k: int) -> np.ndarray:
    """The places of the k least, ties by place; only what isn't beyond the k-th is sorted."""
    near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
    return near[np.lexsort((near, d[near]))[:k]]


class Assigner:
    """Assigns faces one by one: to a person's cluster, to another cluster, or to a new one."""

    def __init__(self, threshold: float, persons: bool = True, neighbours: int = 64):
        self.t, self.persons, self.k = threshold, persons, neighbours
        self.x = np.zeros((0, 0))  # as many rows as there is room for
        self.kept: dict[int, tuple[int, np.ndarray]] = {}  # prototypes of a cluster, and of how many faces
        self.labels: list[int] = []
        self.sums: dict[int, np.ndarray] = {}
        self.counts: dict[int, int] = defaultdict(int)
        self.owner: dict[int, int] = {}
        self.members: dict[int, list[int]] = defaultdict(list)

    def load(self, x: np.ndarray, labels, owners=None) -> None:
        for i, (v, label) in enumerate(zip(_unit(x), labels, strict=True)):
            owner = None if owners is None else owners[i]
            if owner is not None and owner == owner and owner >= 0:
                self.owner[int(label)] = int(owner)
            self._put(v, int(label))

    def _put(self, v: np.ndarray, label: int) -> None:
        n = len(self.labels)
        if n == len(self.x):
            grown = np.zeros((max(64, 2 * n), len(v)))
            grown[:n] = self.x.reshape(n, len(v))
            self.x = grown
        self.x[n] = v
        self.members[label].append(n)
        self.labels.append(label)
        self.sums[label] = self.sums.get(label, 0) + v
        self.counts[label] += 1

    @property
    def rows(self) -> np.ndarray:
        return self.x[: len(self.labels)]

    def _prototypes(self, label: int) -> np.ndarray:
        n = self.counts[label]
        if self.kept.get(label, (0,))[0] != n:
            self.kept[label] = n, select_prototypes(self.x[self.members[label]])
        return self.kept[label][1]

    def add(self, v: np.ndarray) -> int:
        v = _unit(v)
        label = None
        if self.labels:
            d = 1 - self.rows @ v
            order = nearest_rows(d, self.k)
            near = [(float(d[i]), self.labels[i]) for i in order]
            label = (self._of_person(v, near) if self.persons else None) or self._of_cluster(v, near)
        label = max(self.counts, default=0) + 1 if label is None else label
        self._put(v, label)
        return label

    def _of_person(self, v, near) -> int | None:
        close = [(d, self.owner[c], c) for d, c in near if c in self.owner]
        votes = [p for d, p, _ in close if d <= self.t][:5]
        if not votes:
            return None
        scores = []
        for p in {p for d, p, _ in close if d <= self.t}:
            proto = min(float((1 - self._prototypes(c) @ v).min()) for c, q in self.owner.items() if q == p)
            scores.append(((proto + float(np.mean([d for d, q, _ in close if q == p][:3]))) / 2, p))
        scores.sort()
        best, person = scores[0]
        lead = scores[1][0] - best if len(scores) > 1 else math.inf
        n = votes.count(person)
        if n < 2 or n < 0.6 * len(votes) or best > self.t or lead < max(0.02, 0.08 * self.t):
            return None
        return next(c for _, q, c in close if q == person)

    def _of_cluster(self, v, near) -> int | None:
        free = [(d, c) for d, c in near if c not in self.owner]
        votes = [c for d, c in free if d <= self.t][:5]
        scores = []
        for c in dict.fromkeys(c for _, c in free):
            own = [d for d, q in free if q == c]
            centre = float(1 - _unit(self.sums[c]) @ v)
            if own[0] > self.t or centre > self.t:
                continue
            n = votes.count(c)
            if self.counts[c] >= 3 and (sum(d <= self.t for d in own) < 2 or n < 2 or n < 0.6 * len(votes)):
                continue
            scores.append(((own[0] + centre) / 2, c))
        scores.sort()
        if not scores or len(scores) > 1 and scores[1][0] - scores[0][0] < max(0.01, 0.03 * self.t):
            return None
        return scores[0][1]


def assign_incrementally(new: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """(group_id, id, cluster_id): new faces of each group, in id order, assigned among the group's known ones.

    Groups - a person, or the pool of nobody's faces - don't affect each other and run apart.
    New clusters are numbered from the group's largest on.
    """

    def one(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        work = Assigner(threshold, persons=False)
        if len(b):
            b = b.sort_values("id")
            work.load(np.stack(b["vec"].to_numpy()), b["cluster_id"])
        if not len(a):
            return pd.DataFrame(columns=["group_id", "id", "cluster_id"])
        a = a.sort_values("id")
        return pd.DataFrame({"group_id": key[0], "id": a["id"], "cluster_id": [work.add(np.asarray(v)) for v in a["vec"]]})

    left = new.select("group_id", "id", "vec")
    right = known.select(F.col("group_id").alias("_group"), F.col("id").alias("id"), F.col("vec").alias("vec"), F.col("cluster_id").alias("cluster_id"))
    return left.groupBy("group_id").cogroup(right.groupBy("_group")).applyInPandas(one, "group_id bigint, id bigint, cluster_id bigint")


def regroup(faces: DataFrame, threshold: float, cohesion: float | None = None, outlier: float | None = None) -> DataFrame:
    """(id, person_id, cluster_id): a full rebuild. Each person's faces and the pool are grouped apart, small clusters
    consolidated, wide ones split; ids are unique over all groups. No face changes its person.

    ``faces`` has id, person_id (null: the pool) and vec.
    """
    group = F.coalesce("person_id", F.lit(-1)).alias("group_id")
    rows = faces.select(group, "id", "vec")
    first = assign_incrementally(rows, rows.where("false").withColumn("cluster_id", F.lit(0).cast("bigint")), threshold)
    # a cluster's least member names it, whatever group it is in
    def named(df: DataFrame, *keys: str) -> DataFrame:
        return df.withColumn("_c", F.expr(f"min(id) over (partition by {', '.join(keys)})")).select("group_id", "id", F.col("_c").alias("cluster_id"))

    held = named(first, "group_id", "cluster_id").join(rows.select("id", "vec"), "id").withColumn("movable", F.lit(True))
    merged = consolidate(held, threshold, group="group_id").join(held.select("id", "group_id", "vec", "movable"), "id")
    held = named(merged, "group_id", "cluster_id").join(rows.select("id", "vec"), "id").withColumn("movable", F.lit(True))
    parts = split_clusters(held, threshold if cohesion is None else cohesion, outlier).join(held.select("id", "group_id"), "id")
    return named(parts, "group_id", "cluster_id", "part").select("id", F.when(F.col("group_id") >= 0, F.col("group_id")).alias("person_id"), "cluster_id")
