"""Exact vector queries: neighbours, distances, centroids, radii, margins.

Pairs are compared in blocks: vectors are dealt into blocks, each block pair meets in one
task as two matrices, and a task returns the best of its own. No pair row is shuffled.
``pairs_within`` packs each block once, into the shared folder, where the tasks read them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.functions.vector import clipped, distance, normalized
from shoebox.storage import in_small_batches, settled

#: Vectors in a block: a row is copied once for each block of the other side, so larger blocks shuffle less.
BLOCK = 16_384
#: Rows of either side that are multiplied at once inside a pair of blocks; a task holds so many squared distances.
TILE = 1024
#: Blocks that a table is packed into at least, if they have TILE rows; packed blocks that a task holds while others pass by, about.
SPREAD, STRIP = 12, 8


def _blocks(vectors: DataFrame, n_blocks: int, name: str, *keep: str) -> DataFrame:
    """A row for each block: its ids and vectors side by side."""
    # fresh names, as both sides of a comparison may come from one table
    return vectors.select(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias(name), F.col("id").alias(f"{name}_id"), F.col("vec").alias(f"{name}_vec"), *(F.col(c).alias(f"{name}_{c}") for c in keep))


def block_pairs(queries: DataFrame, vectors: DataFrame, work, schema: str, block: int | None = None, group: str | None = None) -> DataFrame:
    """``work(left, right)`` over every pair of a block of queries and a block of vectors.

    ``left`` and ``right`` are (ids, matrix). Each row is copied to as many tasks as the
    other side has blocks, which is what comparing all with all by blocks takes. With
    ``group``, a column of both sides, only rows of the same group meet. A block has about
    ``block`` rows (BLOCK); ``work`` that holds all products of a pair wants small ones.
    """
    size = block or BLOCK
    n = max(1, -(-max(vectors.count(), 1) // size))
    m = max(1, -(-max(queries.count(), 1) // size))
    kept = [group] if group else []
    left = _blocks(queries, m, "qb", *kept).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    right = _blocks(vectors, n, "vb", *kept).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    stack = lambda s: np.stack(s.to_numpy()).astype(np.float64) if len(s) else np.zeros((0, 0))

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        return work((a["qb_id"].to_numpy(), stack(a["qb_vec"])), (b["vb_id"].to_numpy(), stack(b["vb_vec"])))

    return left.groupBy("qb", "vb", *(f"qb_{c}" for c in kept)).cogroup(right.groupBy("qb", "vb", *(f"vb_{c}" for c in kept))).applyInPandas(one, schema)


_PAIR = "id bigint, other bigint, distance double"


def tiles(n: int) -> list[slice]:
    return [slice(i, min(n, i + TILE)) for i in range(0, n, TILE)]


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Where ids of either side are the same; None if nowhere."""
    return a[:, None] == b[None, :] if np.isin(a, b).any() else None


class Nearest:
    """The k nearest others, by rounded distance and then id, of the rows (ids, x), among all that were shown to it.

    A tile's products are only compared with the k-th found so far; what may be nearer is rounded and merged.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, digits: int):
        self.ids, self.x, self.k, self.digits = ids, x, k, digits
        self.d, self.other = np.full((len(ids), k), np.inf), np.zeros((len(ids), k), np.int64)

    def look(self, ids: np.ndarray, y: np.ndarray) -> None:
        for r in tiles(len(self.ids)):
            for c in tiles(len(ids)):
                self._tile(r, ids[c], y[c])

    def _tile(self, r: slice, ids: np.ndarray, y: np.ndarray) -> None:
        s, k, slack = self.x[r] @ y.T, self.k, 2 * 10.0**-self.digits + 1e-12
        same = _shared(self.ids[r], ids)
        if same is not None:
            s[same] = -np.inf
        least = 1 - self.d[r, k - 1] - slack  # what is less can't be among the k
        if np.isinf(least).any() and s.shape[1] > k:
            s[np.isnan(s)] = -np.inf
            least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - slack)
        i, j = np.nonzero(s >= least[:, None])
        d, other = np.round(1 - s[i, j], self.digits), ids[j]
        last = self.d[r, k - 1][i]
        fine = np.isfinite(d) & ((d < last) | ((d == last) & (other < self.other[r, k - 1][i])))
        i, d, other = i[fine], d[fine], other[fine]
        if not len(i):
            return
        own = np.unique(i)
        rows, d, other = np.r_[np.repeat(own, k), i], np.r_[self.d[r][own].ravel(), d], np.r_[self.other[r][own].ravel(), other]
        order = np.lexsort((other, d, rows))
        rows = rows[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        order = order[place < k]
        self.d[r.start + own], self.other[r.start + own] = d[order].reshape(-1, k), other[order].reshape(-1, k)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id, other, distance)"""
        there = np.isfinite(self.d)
        return np.repeat(self.ids, there.sum(1)), self.other[there], self.d[there]


def knn(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 6, group: str | None = None) -> DataFrame:
    """(id, other, distance, rank): the k nearest others of each query, of its ``group`` if that is given; ties by id. A task keeps k of its block."""

    def work(a, b):
        near = Nearest(*a, k, digits)
        near.look(*b)
        return pd.DataFrame(dict(zip(("id", "other", "distance"), near.found(), strict=True)))

    near = block_pairs(queries, vectors, work, _PAIR, group=group)
    ranked = near.withColumn("rank", F.expr("row_number() over (partition by id order by distance, other)"))
    return ranked.where(F.col("rank") <= k)


def _pack(table: pa.Table) -> pa.Table:
    table = table.sort_by("id")
    ids, x = table.column("id").combine_chunks(), table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return pa.Table.from_arrays([table.column("block").slice(0, 1), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([x.tobytes()], pa.binary())], ["block", "ids", "m"])


def packed(vectors: DataFrame) -> DataFrame:
    """(block, ids, m): a row for each block of about BLOCK vectors, in the order of their ids, written to the shared folder; a partition has STRIP of them at most, about."""
    rows = vectors.where("id is not null and vec is not null").select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    n_rows = max(vectors.count(), 1)
    n = -(-n_rows // min(BLOCK, max(TILE, -(-n_rows // SPREAD))))
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"), "id", "vec").repartitionByRange(min(n, max(4 * SPREAD, -(-n // STRIP))), "block")
    return settled(in_small_batches(dealt).groupBy("block").applyInArrow(_pack, "block int, ids array<bigint>, m binary"))


def pairs_within(vectors: DataFrame, limit: float, digits: int = 6) -> DataFrame:
    """(id, other, distance) for id < other at most ``limit`` apart.

    Blocks are packed once and meet as a cross join of partitions, which are read where they
    stand: nothing is copied or shuffled for a pair of blocks, so what is written grows with
    the table, though pairs and rows found grow with its square. A pair of blocks meets once,
    and hands on what it finds tile by tile.
    """
    held = packed(vectors)
    a, b = (held.select(F.col("block").alias(n), F.col("ids").alias(f"{n}_ids"), F.col("m").alias(f"{n}_m")) for n in "ij")
    met = a.join(b.hint("shuffle_replicate_nl"), F.col("i") <= F.col("j"))
    least = 1 - limit - 10.0**-digits  # what is less is beyond the limit however it is rounded

    def rows(ids: pa.Scalar, m: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        return ids.values.to_numpy(), np.frombuffer(m.as_buffer()).reshape(len(ids), -1)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, *sides in zip(*(batch.column(c) for c in ("i", "j", "i_ids", "i_m", "j_ids", "j_m")), strict=True):
                (a, xa), (b, xb) = rows(*sides[:2]), rows(*sides[2:])
                for r, c in ((r, c) for r in tiles(len(a)) for c in tiles(len(b)) if i != j or r.start <= c.start):  # a block has its ids in order
                    s = (xa[r] @ xb[c].T).ravel()
                    near = np.flatnonzero(s >= least)
                    k, m = np.divmod(near, c.stop - c.start)
                    d, u, v = np.round(1 - s[near], digits), a[r][k], b[c][m]
                    fine = (d <= limit) & (u < v if i == j else u != v)
                    d, u, v = d[fine], u[fine], v[fine]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(d)], ["id", "other", "distance"])

    return met.mapInArrow(one, _PAIR)


def _two_least(d: np.ndarray) -> np.ndarray:
    """The two least of each row, ascending; infinity where there are none. ``d`` is changed."""
    if d.shape[1] < 2:
        d = np.concatenate([d, np.full((len(d), 2 - d.shape[1]), np.inf)], axis=1)
    rows, at = np.arange(len(d)), d.argmin(1)
    one = d[rows, at]
    d[rows, at] = np.inf
    return np.stack([one, d.min(1)], axis=1)


def _two_nearest(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, but_itself: bool = True) -> np.ndarray:
    """The two least distances of each row of x to those of y, tile by tile."""
    best = np.full((len(ids), 2), np.inf)
    for r in tiles(len(ids)):
        for c in tiles(len(others)):
            d = 1 - x[r] @ y[c].T
            same = _shared(ids[r], others[c]) if but_itself else None
            if same is not None:
                d[same] = np.inf
            best[r] = _two_least(np.concatenate([best[r], _two_least(d)], axis=1))
    return best


def nearest_two(targets: DataFrame, references: DataFrame, group: str, but_itself: bool = True) -> DataFrame:
    """(id, group, nearest, second): each target's two least distances to the references of each group, a reference of its own id excluded if ``but_itself``.

    second is null where a group has one such reference. A task returns one row per target and group.
    """
    n = max(1, -(-max(references.count(), 1) // BLOCK))
    m = max(1, -(-max(targets.count(), 1) // BLOCK))
    left = _blocks(targets, m, "qb").withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    right = references.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("vb"), F.col(group).cast("bigint").alias("g"), F.col("id").alias("vb_id"), F.col("vec").alias("vb_vec")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["id", "g", "one", "two"])
        ids, x, out = a["qb_id"].to_numpy(), np.stack(a["qb_vec"].to_numpy()), []
        for g, part in b.groupby("g"):
            two = _two_nearest(ids, x, part["vb_id"].to_numpy(), np.stack(part["vb_vec"].to_numpy()), but_itself)
            out.append(pd.DataFrame({"id": ids, "g": g, "one": two[:, 0], "two": two[:, 1]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["id", "g", "one", "two"])

    parts = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(one, "id bigint, g bigint, one double, two double")
    return _merged_two(parts, "id", "g").select("id", F.col("g").alias(group), "nearest", "second")


def _merged_two(parts: DataFrame, *keys: str) -> DataFrame:
    """(keys, nearest, second) from the two least of each block; a block gives two numbers at most."""
    held = parts.groupBy(*keys).agg(F.array_sort(F.filter(F.concat(F.collect_list("one"), F.collect_list("two")), lambda x: x < float("inf"))).alias("near"))
    return held.where(F.size("near") > 0).select(*keys, F.get("near", F.lit(0)).alias("nearest"), F.get("near", F.lit(1)).alias("second"))


def nearest_two_within(faces: DataFrame, group: str) -> DataFrame:
    """(id, nearest, second): each face's two least distances to the others of its own group; second is null where there is one other."""
    rows = faces.select("id", F.col(group).cast("bigint").alias("g"), "vec")
    return nearest_two_of(rows, rows).select("id", "nearest", "second")


def nearest_two_of(targets: DataFrame, references: DataFrame, most: int | None = None) -> DataFrame:
    """(id, g, nearest, second) of ``targets`` (id, g, vec) among the ``references`` (id, g, vec) of the group that each asks for.

    Groups meet in blocks of about ``most`` rows (BLOCK) on either side, whatever a group's size.
    """
    most = most or BLOCK
    sizes = references.groupBy("g").agg(F.ceil(F.count("*") / most).cast("int").alias("_rb"))
    asked = targets.groupBy("g").agg(F.ceil(F.count("*") / most).cast("int").alias("_tb"))
    both = sizes.join(asked, "g")
    part = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = targets.join(both, "g").select("g", part("_tb").alias("t"), every("_rb").alias("r"), "id", "vec")
    right = references.join(both, "g").select(F.col("g").alias("_g"), part("_rb").alias("_r"), every("_tb").alias("_t"), F.col("id").alias("_id"), F.col("vec").alias("_vec"))

    def one(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["id", "g", "one", "two"])
        two = _two_nearest(a["id"].to_numpy(), np.stack(a["vec"].to_numpy()), b["_id"].to_numpy(), np.stack(b["_vec"].to_numpy()))
        return pd.DataFrame({"id": a["id"], "g": key[0], "one": two[:, 0], "two": two[:, 1]})

    parts = left.groupBy("g", "t", "r").cogroup(right.groupBy("_g", "_t", "_r")).applyInPandas(one, "id bigint, g bigint, one double, two double")
    return _merged_two(parts, "id", "g")


def nearest_reference(targets: DataFrame, references: DataFrame, group: str, but_itself: bool = False) -> DataFrame:
    """(id, group, distance): each target's least distance to the references of each group."""
    return nearest_two(targets, references, group, but_itself).select("id", group, F.col("nearest").alias("distance"))


def best_and_runner_up(distances: DataFrame, group: str) -> DataFrame:
    """(id, best, best_distance, margin): each target's nearest group and how much nearer it is than the next; one group has no margin."""
    ranked = distances.withColumn("_r", F.expr(f"row_number() over (partition by id order by distance, {group})")).where("_r <= 2")
    at = lambda r, c: F.max(F.when(F.col("_r") == r, F.col(c)))
    return ranked.groupBy("id").agg(at(1, group).alias("best"), at(1, "distance").alias("best_distance"), (at(2, "distance") - at(1, "distance")).alias("margin"))


def centroids(vectors: DataFrame, key: str) -> DataFrame:
    """(key, centroid, n): the normalised mean of each group; sums are taken by dimension, in part before the shuffle."""
    each = vectors.where(F.col(key).isNotNull()).select(key, F.posexplode("vec").alias("i", "x"))
    sums = each.groupBy(key, "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    held = sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda s: s["s"]).alias("sum"), F.max("n").alias("n"))
    return held.select(key, normalized(F.col("sum")).alias("centroid"), "sum", "n")


def radii(vectors: DataFrame, key: str, share: float = 0.95) -> DataFrame:
    """(key, n, radius): the quantile of the distances of a group's members to its centroid."""
    placed = vectors.join(centroids(vectors, key), key).select(key, distance(F.col("vec"), F.col("centroid")).alias("d"))
    return placed.groupBy(key).agg(F.count("*").alias("n"), F.percentile("d", share).alias("radius"))


def balanced_sample(faces: DataFrame, per_cluster: int = 100, per_person: int = 100, total: int = 4000) -> DataFrame:
    """At most so many faces a cluster, a person and in all, dealt in turns: three ranks, each over what the last left."""
    a = faces.withColumn("r1", F.expr("row_number() over (partition by person_id, cluster_id order by id)")).where(F.col("r1") <= per_cluster)
    b = a.withColumn("r2", F.expr("row_number() over (partition by person_id order by r1, cluster_id)")).where(F.col("r2") <= per_person)
    return b.orderBy("r2", "person_id").limit(total)


def leave_one_out(vectors: DataFrame, key: str) -> DataFrame:
    """(id, key, distance): how far each member is from the centroid of the others; null where there are none."""
    joined = vectors.join(centroids(vectors, key), key)
    rest = F.zip_with("sum", "vec", lambda s, x: s - x)
    return joined.select("id", key, F.when(F.col("n") > 1, clipped(distance(F.col("vec"), normalized(rest)), 0.0, 2.0)).alias("distance"))
