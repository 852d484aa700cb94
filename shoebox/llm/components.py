"""Connected components of a graph held as a DataFrame of edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import cut, forget

#: So many edges are one task's work; more of them go through rounds of joins.
SMALL = 50_000


def hook(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Merge the classes of u[i] and v[i]; a class is named by its least position."""
    while True:
        a, b = labels[u], labels[v]
        open_ = a != b
        if not open_.any():
            return
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


def _in_one_task(batches):
    """The rows (node, root) of all edges (node, near) of a task."""
    held = [(b.column("node").to_numpy(), b.column("near").to_numpy()) for b in batches]
    a, b = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 2
    names, at = np.unique(np.r_[a, b], return_inverse=True)
    labels = np.arange(len(names))
    hook(labels, at[: len(a)], at[len(a) :])
    far = labels != np.arange(len(labels))
    yield pa.RecordBatch.from_arrays([pa.array(names[far]), pa.array(names[labels[far]])], ["node", "root"])


def _stars(pairs: DataFrame) -> DataFrame:
    """Edges (node, near) with the least neighbour of each node, itself included."""
    least = pairs.groupBy("node").agg(F.min("near").alias("least"))
    return pairs.join(least, "node").withColumn("least", F.least("node", "least"))


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Label every node of ``edges`` (a, b: bigint) with the least node that it reaches.

    Up to SMALL edges are one task's work. More alternate large stars and small stars
    until the edges stand still, with the same outcome; each round ends in a written table, so that lineage stays short and a lost executor costs
    one round at most. Loops and repeated edges don't matter; null ends are dropped.
    Returns (node, root), for nodes with another root than themselves only.
    """
    held = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("near")).distinct(),
        "edges",
    )
    if held.count() <= SMALL:
        return cut(held.repartition(1).mapInArrow(_in_one_task, "node bigint, root bigint"), "roots")
    seen = None
    for _ in range(max_rounds):
        both = held.unionByName(held.select(F.col("near").alias("node"), F.col("node").alias("near")))
        large = _stars(both).where("near > node").select(F.col("near").alias("node"), F.col("least").alias("near")).distinct()
        small = _stars(large)
        small = (
            small.where("near <> least").select(F.col("near").alias("node"), F.col("least").alias("near"))
            .unionByName(small.select("node", F.col("least").alias("near"))).where("node <> near").distinct()
        )
        held, before = cut(small, "edges"), held
        forget(before)
        now = held.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "near")), F.bit_xor(F.xxhash64("near", "node"))).first()
        if now == seen:
            return held.select("node", F.col("near").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
