"""Connected components of edges between ids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.storage import settled


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' component, for edges that fit one task."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, root) of every node of ``edges`` (a, b) whose component has a lesser node, root being the least.

    Each node points to the least node near it; rounds shorten the pointers until they
    stand still. A node of many edges sends them to its least neighbour, in part before
    the shuffle, so no list of a node's edges is held. Loops and repeats don't matter.
    """
    held = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    for _ in range(most_rounds):
        both = held.unionByName(held.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("near")).select("hi", F.least("hi", "near").alias("near"))
        # every larger neighbour is handed to the least one
        large = both.where("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("near").alias("lo"))
        tops = large.groupBy("hi").agg(F.min("lo").alias("near"))
        small = large.join(tops, "hi").where("lo <> near").select(F.col("lo").alias("hi"), F.col("near").alias("lo")).unionByName(tops.select("hi", F.col("near").alias("lo")))
        new = settled(small.where("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct())
        # nothing moves once each node has one lesser neighbour that has none
        tall = new.groupBy("hi").count().where("count > 1").limit(1).count() or new.join(new.select(F.col("lo").alias("hi")), "hi", "left_semi").limit(1).count()
        held = new
        if not tall:
            return held.select(F.col("hi").alias("id"), F.col("lo").alias("root"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
