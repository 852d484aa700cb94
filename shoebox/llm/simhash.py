"""SimHash near-duplicates: fingerprints joined by a binary trie walked in node pairs.

A sorted run of distinct fingerprints is a binary trie: a node is a range that shares
its leading bits. The self-join starts from pairs (node, node), splits both nodes on
the next bit, adds one error where the bits differ, and drops a pair once its errors
exceed the budget. To deal the work out, fingerprints are turned so that each of
``budget + 1`` bit blocks leads once: two fingerprints within the budget agree on
at least one block, so the walk below one leading block value is a task's own work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import byte_texts, cut, in_small_batches
from shoebox.llm.components import connected_components, hook

BITS = 64
#: Node pairs that the walk holds at once, and the pairs of a small node pair that are compared outright.
FRONTIER, DIRECT = 1 << 18, 16
#: Turned fingerprints in one task.
TASK_ROWS = 2_000_000


def fingerprint(text: bytes, width: int = 3) -> int:
    """The signed 64-bit fingerprint of a UTF-8 text; zero where there is no word."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(s, 42) for s in shingles], dtype=np.uint64))


def majority(h: np.ndarray) -> int:
    """The signed 64-bit fingerprint of uint64 hashes: the bits that over half of them have."""
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; null and blank texts have fingerprint 0."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([fingerprint(t, width) for t in byte_texts(b)], pa.int64())], ["doc_id", "fp"]
            )

    return in_small_batches(docs).select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, fp bigint")


def trie_links(keys: np.ndarray, depth: int, budget: int) -> np.ndarray:
    """Classes of the sorted distinct uint64 ``keys`` that share their first ``depth`` bits
    and are linked by steps of at most ``budget`` differing bits: the least position of each."""
    n = len(keys)
    labels = np.arange(n)
    if n < 2:
        return labels
    head = keys >> np.uint64(BITS - depth) if depth else np.zeros(n, np.uint64)
    starts = np.flatnonzero(np.r_[True, head[1:] != head[:-1]])
    ends = np.r_[starts[1:], n]
    wide = ends - starts > 1
    a0, a1 = starts[wide], ends[wide]
    todo = [(a0[s : s + FRONTIER], a1[s : s + FRONTIER], a0[s : s + FRONTIER], a1[s : s + FRONTIER], np.zeros(len(a0[s : s + FRONTIER]), np.int8), depth) for s in range(0, len(a0), FRONTIER)]
    while todo:
        a0, a1, b0, b1, err, d = todo.pop()
        small = (a1 - a0) * (b1 - b0) <= DIRECT
        if d == BITS:
            small[:] = True
        if small.any():
            sa, na, sb, nb = a0[small], (a1 - a0)[small], b0[small], (b1 - b0)[small]
            size = na * nb
            at = np.repeat(np.arange(len(size)), size)
            k = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
            u, v = sa[at] + k // nb[at], sb[at] + k % nb[at]
            near = np.bitwise_count(keys[u] ^ keys[v]) <= budget
            near &= u != v
            hook(labels, u[near], v[near])
            a0, a1, b0, b1, err = (x[~small] for x in (a0, a1, b0, b1, err))
        if not len(a0):
            continue
        bit = np.uint64(1) << np.uint64(BITS - 1 - d)
        cut_ = lambda lo, hi: _split(keys, lo, hi, bit)
        am, bm = cut_(a0, a1), cut_(b0, b1)
        same = a0 == b0
        parts = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1)]
        other = ~same
        parts.append((am[other], a1[other], b0[other], bm[other], err[other] + 1))
        merged = [np.concatenate(x) for x in zip(*parts, strict=True)]
        keep = (merged[1] > merged[0]) & (merged[3] > merged[2]) & (merged[4] <= budget)
        keep &= (merged[0] != merged[2]) | (merged[1] - merged[0] > 1)
        merged = [x[keep] for x in merged]
        for s in range(0, len(merged[0]), FRONTIER):
            todo.append((*(x[s : s + FRONTIER] for x in merged), d + 1))
    return labels


def _split(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where, in each range of a shared prefix, the given bit turns to one: a bisection of all ranges at once."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        one = (keys[np.minimum(mid, len(keys) - 1)] & bit) != 0
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)


def fingerprint_links(fps: DataFrame, budget: int = 3) -> DataFrame:
    """Edges (a, b) that span the classes of the distinct fingerprints ``fp`` within ``budget`` bits.

    A task returns one edge per fingerprint and class, never all pairs of a class.
    """
    blocks = budget + 1
    width = BITS // blocks
    turned = fps.select("fp", F.explode(F.array(*(F.lit(i) for i in range(blocks)))).alias("turn"))
    shift = F.col("turn") * width
    value = F.expr(f"shiftrightunsigned(fp, turn * {width})").bitwiseAND(F.lit((1 << width) - 1))
    total = fps.count() * blocks
    tasks = max(fps.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_ROWS))
    turned = turned.withColumn("block", value + shift * F.lit(1 << width)).repartition(tasks, "turn", "block").select("fp", "turn")

    def run(batches):
        held = [(b.column("fp").to_numpy(), b.column("turn").to_numpy()) for b in batches]
        if not held:
            return
        fp, turn = (np.concatenate(x) for x in zip(*held, strict=True))
        for t in range(blocks):
            raw = fp[turn == t].view(np.uint64)
            # the block at bits [t * width, t * width + width) leads
            left = (BITS - (t + 1) * width) % BITS
            keys = (raw << np.uint64(left)) | (raw >> np.uint64(BITS - left)) if left else raw.copy()
            order = np.argsort(keys)
            keys, raw = keys[order], raw[order]
            root = trie_links(keys, width, budget)
            far = root != np.arange(len(root))
            if far.any():
                yield pa.RecordBatch.from_arrays([pa.array(raw[far].view(np.int64)), pa.array(raw[root[far]].view(np.int64))], ["a", "b"])

    return turned.mapInArrow(run, "a bigint, b bigint")


def simhash_components(docs: DataFrame, width: int = 3, budget: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the least doc_id that links of at most ``budget`` differing bits reach.
    Rows that share a fingerprint are one node, so copies cost one row. Null and blank
    texts share fingerprint 0, which links like any other. Repeated rows stay; a null
    doc_id stays too and never names a component unless all of it are null. An empty
    table gives an empty result; other columns of ``docs`` are ignored.
    """
    rows = cut(fingerprints(docs, width), "fingerprints")
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least_doc")), "nodes")
    roots = connected_components(fingerprint_links(nodes.select("fp"), budget))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least_doc", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least_doc").alias("component_id"))
    # only the fingerprints of classes with two or more members need another look
    return rows.join(named.join(least, "root").select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")


def op2(docs: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    found = simhash_components(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
