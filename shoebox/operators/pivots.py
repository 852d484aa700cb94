"""Exact neighbours through blocks of like vectors.

Vectors are dealt to the nearest of a few pivots, so a block is narrow: it has a centre
and a largest angle to it. By the triangle inequality on angles two vectors are at least
as far apart as their centres less both radii; a pair of blocks whose bound is beyond the
k-th neighbour that each query has found already needs no look. What first neighbours are
found in are the blocks of nearest centres.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.operators import vectors as V
from shoebox.storage import in_small_batches, settled

#: Pivots at most, which every task gets; vectors of a block, about; blocks of nearest centres that are looked at first.
PIVOTS, BLOCK, FIRST = 1024, 1024, 2
#: Blocks that meet as many in one task.
STRIP = 16
#: Vectors that pivots are chosen from, for each pivot.
SAMPLE = 8
_BLOCK = "block int, n int, ids array<bigint>, m binary, centre array<double>, radius double"
_FOUND = "i int, id bigint, other bigint, distance double"


def choose(vectors: DataFrame, most: int) -> np.ndarray:
    """``most`` vectors that lie far apart, each the farthest from those before, among SAMPLE times as many that a hash of the ids picks; these are rows on the driver."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * most).select("vec").collect()
    x = np.array([r.vec for r in rows], np.float64)
    if len(x) <= most:
        return x
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < most:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


def _pack(table: pa.Table) -> pa.Table:
    x = np.stack([np.asarray(v, np.float64) for v in table.column("vec").to_pylist()])
    centre = x.sum(0)
    centre = centre / max(np.linalg.norm(centre), 1e-12)
    radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
    ids = table.column("id").to_pylist()
    return pa.Table.from_pylist([{"block": table.column("block")[0].as_py(), "n": len(ids), "ids": ids, "m": x.tobytes(), "centre": centre.tolist(), "radius": radius}], schema=pa.schema([("block", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("m", pa.binary()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64())]))


def blocks(vectors: DataFrame, pivots: np.ndarray, block: int = BLOCK) -> DataFrame:
    """A row for each block: (block, n, ids, m, centre, radius). Vectors of one pivot that are more than ``block`` are parted by a hash of their ids."""

    def near(batches):
        for b in batches:
            x = np.stack([np.asarray(v, np.float64) for v in b.column("vec").to_pylist()]) if b.num_rows else np.zeros((0, pivots.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array((x @ pivots.T).argmax(1).astype(np.int32))], ["id", "vec", "pivot"])

    held = settled(in_small_batches(vectors).select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec")).mapInArrow(near, "id bigint, vec array<double>, pivot int"))
    sizes = dict(map(tuple, held.groupBy("pivot").count().collect()))  # a row for each pivot
    parts = [-(-sizes.get(p, 0) // block) for p in range(len(pivots))]
    before = np.cumsum([0, *parts]).tolist()
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("pivot") + 1)
    number = (of(before[:-1]) + F.pmod(F.xxhash64("id"), F.greatest(of(parts), F.lit(1)))).cast("int")
    return settled(held.select(number.alias("block"), "id", "vec").groupBy("block").applyInArrow(_pack, _BLOCK))


def _summaries(held: DataFrame, most: Column | float = 0.0) -> DataFrame:
    """Centres as vectors, their radius and the farthest distance that matters in front."""
    return held.select(F.col("block").cast("bigint").alias("id"), F.concat(F.array(F.col("radius"), most if isinstance(most, Column) else F.lit(most)), F.col("centre")).alias("vec"))


def first_pairs(queries: DataFrame, references: DataFrame, first: int = FIRST) -> DataFrame:
    """(i, j): the blocks of references whose centres are nearest to each block of queries."""

    def work(a, b):
        d = 1 - a[1][:, 2:] @ b[1][:, 2:].T
        near = np.argsort(d, axis=1, kind="stable")[:, :first]
        rows = np.repeat(np.arange(len(a[0])), near.shape[1])
        return pd.DataFrame({"id": a[0][rows], "other": b[0][near.ravel()], "distance": d[rows, near.ravel()]})

    ranked = V.block_pairs(_summaries(queries), _summaries(references), work, "id bigint, other bigint, distance double", block=2048)
    ranked = ranked.withColumn("_r", F.expr("row_number() over (partition by id order by distance, other)")).where(F.col("_r") <= first)
    return ranked.select(F.col("id").cast("int").alias("i"), F.col("other").cast("int").alias("j"))


def pairs_within(queries: DataFrame, references: DataFrame) -> DataFrame:
    """(i, j): the pairs of blocks that may hold two vectors at most ``most``, a column of the query blocks, apart."""

    def work(a, b):
        angle = np.arccos(np.clip(a[1][:, 2:] @ b[1][:, 2:].T, -1, 1)) - a[1][:, :1] - b[1][:, :1].T
        i, j = np.nonzero(1 - np.cos(np.clip(angle, 0, np.pi)) <= a[1][:, 1:2] + 1e-9)
        return pd.DataFrame({"id": a[0][i], "other": b[0][j]})

    found = V.block_pairs(_summaries(queries, F.col("most")), _summaries(references), work, "id bigint, other bigint", block=2048)
    return found.select(F.col("id").cast("int").alias("i"), F.col("other").cast("int").alias("j"))


def scored(pairs: DataFrame, queries: DataFrame, references: DataFrame, k: int, digits: int) -> DataFrame:
    """(i, id, other, distance): the k nearest others of each query of block i in the blocks j of a strip, for all ``pairs``.

    Blocks meet by strips of STRIP on either side, so a block is copied once for each strip that
    it is asked for in, not for each block; a query keeps k of a strip.
    """
    strip = lambda c: F.floor(F.col(c) / STRIP).cast("int")
    wanted = pairs.select("i", "j", strip("i").alias("a"), strip("j").alias("b"))
    asked = wanted.groupBy("i", "a", "b").agg(F.collect_list("j").alias("js"))
    left = asked.join(queries.select(F.col("block").alias("i"), "ids", "m"), "i").select("a", "b", F.col("i").alias("block"), "js", "ids", "m")
    right = wanted.select("j", "a", "b").distinct().join(references.select(F.col("block").alias("j"), F.col("ids").alias("_ids"), F.col("m").alias("_m")), "j").select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("j").alias("_block"), "_ids", "_m")

    def rows(ids: pa.Scalar, m: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        own = np.array(ids.as_py(), np.int64)
        return own, np.frombuffer(m.as_py()).reshape(len(own), -1)

    def work(one: pa.Table, two: pa.Table) -> pa.Table:
        there = {j: rows(ids, m) for j, ids, m in zip(two.column("_block").to_pylist(), two.column("_ids"), two.column("_m"), strict=True)}
        out = []
        for i, js, ids, m in zip(one.column("block").to_pylist(), one.column("js").to_pylist(), one.column("ids"), one.column("m"), strict=True):
            near = V.Nearest(*rows(ids, m), k, digits)
            for j in sorted(js):
                near.look(*there[j])
            found = near.found()
            out.append(pa.Table.from_arrays([pa.array(np.full(len(found[0]), i, np.int32)), *map(pa.array, found)], ["i", "id", "other", "distance"]))
        empty = pa.schema([("i", pa.int32()), ("id", pa.int64()), ("other", pa.int64()), ("distance", pa.float64())]).empty_table()
        return pa.concat_tables([empty, *out])

    return left.groupBy("a", "b").cogroup(right.groupBy("_a", "_b")).applyInArrow(work, _FOUND)


def knn(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 6, block: int = BLOCK, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """(found, looked): the k nearest others (id, other, distance, rank) of each query, ties by id, and the pairs of blocks (i, j) that were multiplied.

    The rows are those of ``vectors.knn``; unit vectors are asked for. Tables without rows give none.
    """
    n = vectors.count()
    chosen = choose(vectors, min(pivots, max(1, -(-n // block))))
    if not len(chosen):
        return queries.select("id", F.col("id").alias("other"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank")).where("false"), queries.selectExpr("0 as i", "0 as j").where("false")
    right = blocks(vectors, chosen, block)
    left = right if queries is vectors else blocks(queries, chosen, block)
    start = settled(first_pairs(left, right))
    place = F.expr("row_number() over (partition by id order by distance, other)")
    near = settled(scored(start, left, right, k, digits).withColumn("rank", place).where(F.col("rank") <= k))
    # a query with less than k neighbours so far may have any
    each = near.groupBy("i", "id").agg(F.count("*").alias("c"), F.max("distance").alias("d"))
    far = each.groupBy("i").agg(F.count("*").alias("seen"), F.min("c").alias("least"), F.max("d").alias("d"))
    most = F.when((F.col("seen") == F.col("n")) & (F.col("least") == k), F.col("d") + 10.0**-digits).otherwise(4.0)
    bounded = left.join(far, left["block"] == far["i"], "left").select(*left.columns, most.alias("most"))
    rest = settled(pairs_within(bounded, right).join(start, ["i", "j"], "left_anti"))
    more = scored(rest, left, right, k, digits)
    found = near.drop("rank").unionByName(more).withColumn("rank", place).where(F.col("rank") <= k).select("id", "other", "distance", "rank")
    return found, start.unionByName(rest)
