"""Hard-negative mining by a block matrix multiply over rows and dimensions.

Anchors and rows are dealt into blocks, vectors into chunks of dimensions. A tile is what
one block has in one chunk, packed once in the narrowest integers that hold it. As in
SUMMA a tile of scores stays where it is: all chunks of a block of anchors and a block of
rows meet in one task, which multiplies them chunk by chunk and adds the products up, a
strip of anchors at a time. What leaves the task is a few rows for each anchor and window,
and those are reduced once more over all blocks. So rows travel once for each block of
anchors, and no score does.

Blocks of rows hold one group of labels. The first pass finds an anchor's positives and
multiplies anchors by rows of their own label only; the second, which finds negatives in
the window under each positive's score, leaves out anchors whose label is the only one of
a block. So hardly a product is made twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import cut, forget, in_small_batches

#: Groups of labels; a group has as many blocks as its rows need.
GROUPS = 64
#: Rows and anchors of a block, about; dimensions of a chunk; anchors of a strip of scores.
ROWS, ANCHORS, CHUNK, STRIP = 16_384, 4096, 32, 64
#: Components of a block, about, where vectors are long.
CELLS = 1 << 21
_TILE = "block int, k int, rids array<bigint>, vec_ids array<bigint>, labels array<bigint>, m binary"
_WINS = "array<struct<arid:bigint,prid:bigint,pid:bigint,score:bigint>>"
_FIRST = "i int, arid bigint, anchor_id bigint, prid bigint, positive_id bigint, positive_score bigint"
_FOUND = "arid bigint, anchor_id bigint, prid bigint, positive_id bigint, positive_score bigint, nrid bigint, negative_id bigint, negative_score bigint"


def quantised(vectors: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, label, v) of the rows that can take part: v is floor(scale * x) of each component, as double.

    Rows with a null label, a null vector, or a null or non-finite component are left out.
    """
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return vectors.where(F.col("label").isNotNull() & F.col(vector).isNotNull() & fine).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v")
    )


def _pack(table: pa.Table) -> pa.Table:
    """The tile of a block and a chunk. Vectors that end early count zeros; ids and labels go with the first chunk alone."""
    table = table.sort_by("rid")
    parts = table.column("part").combine_chunks()
    sizes = np.asarray(parts.value_lengths(), np.int64)
    m = np.zeros((len(sizes), CHUNK), np.int64)
    m[np.repeat(np.arange(len(sizes)), sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.asarray(parts.flatten(), np.int64)
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= m.min() and m.max() <= np.iinfo(t).max)
    k = table.column("k")[0].as_py()
    whole = lambda c: pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), table.column(c).combine_chunks())
    meta = [whole(c) if k == 0 else pa.nulls(1, pa.list_(pa.int64())) for c in ("vec_id", "label")]
    return pa.Table.from_arrays([table.column("block").slice(0, 1), table.column("k").slice(0, 1), whole("rid"), *meta, pa.array([m.astype(kind).tobytes()], pa.binary())], ["block", "k", "rids", "vec_ids", "labels", "m"])


def tiles(rows: DataFrame, block: Column, chunk: int = CHUNK) -> DataFrame:
    """One row for each block and chunk of dimensions; every row has a first chunk, be its vector empty."""
    last = F.greatest(F.ceil(F.size("v") / chunk).cast("int"), F.lit(1)) - 1
    parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice("v", k * chunk + 1, F.lit(chunk)))
    return rows.select(block.alias("block"), "rid", "vec_id", "label", F.posexplode(parts).alias("k", "part")).groupBy("block", "k").applyInArrow(_pack, _TILE)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, through doubles where these hold every sum exactly, else modulo 2^64."""
    most = [int(max(abs(int(x.max())), abs(int(x.min())))) if x.size else 0 for x in (a, b)]
    if most[0] * most[1] * CHUNK < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class _Block(NamedTuple):
    """Rows in the order of their labels, then ids, a missing one last; chunks are (places, matrix, largest component) by number."""

    rids: np.ndarray
    vec_ids: pa.Array
    labels: np.ndarray
    place: np.ndarray  #: by id alone, whatever the label
    chunks: dict[int, tuple[np.ndarray, np.ndarray, int]]


def _block(tiles: pa.Table) -> _Block:
    tiles = tiles.sort_by("k").combine_chunks()
    rids, vec_ids, labels = (tiles.column(c)[0].values for c in ("rids", "vec_ids", "labels"))
    rids, labels, ids, none = rids.to_numpy(), labels.to_numpy(), vec_ids.fill_null(0).to_numpy(), vec_ids.is_null().to_numpy(zero_copy_only=False)
    by_id = np.lexsort((rids, ids, none))
    order = by_id[np.argsort(labels[by_id], kind="stable")]
    back, place = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    back[order], place[by_id] = np.arange(len(order)), np.arange(len(order))
    chunks = {}
    for k, some, m in zip(tiles.column("k").to_pylist(), tiles.column("rids"), tiles.column("m"), strict=True):
        raw = m.as_buffer()
        x = np.frombuffer(raw, f"i{raw.size // (len(some) * CHUNK)}").reshape(-1, CHUNK)  # as wide as _pack made it
        at = back[np.searchsorted(rids, some.values.to_numpy())]  # vectors that have ended are in no later chunk
        by = np.argsort(at)
        chunks[k] = at[by], x[by], max(int(x.max()), -int(x.min()))
    return _Block(rids[order], vec_ids.take(pa.array(order)), labels[order], place[order], chunks)


class _Scores:
    """The tile of scores of two blocks: numbers of a kind that holds every sum exactly, or int64, modulo 2^64."""

    def __init__(self, a: _Block, b: _Block):
        both = sorted(a.chunks.keys() & b.chunks.keys())
        most = sum(a.chunks[k][2] * b.chunks[k][2] * CHUNK for k in both)
        self.kind, self.bound = next(((t, n) for t, n in ((np.float32, 1 << 24), (np.float64, 1 << 53)) if most < n), (np.int64, 1 << 63))
        self.chunks = [tuple((at, x.astype(self.kind)) for at, x, _ in (a.chunks[k], b.chunks[k])) for k in both]

    def of(self, rows: slice, cols: slice) -> np.ndarray:
        """The scores of these anchors and rows, added up over the chunks."""
        total = np.zeros((rows.stop - rows.start, cols.stop - cols.start), self.kind)
        for (at, x), (to, y) in self.chunks:
            r, c = slice(*np.searchsorted(at, (rows.start, rows.stop))), slice(*np.searchsorted(to, (cols.start, cols.stop)))
            part = _times(x[r], y[c]) if self.kind is np.int64 else x[r] @ y[c].T
            if part.shape == total.shape:
                total += part
            else:
                total[np.ix_(at[r] - rows.start, to[c] - cols.start)] += part
        return total

    def limit(self, x: np.ndarray) -> np.ndarray:
        """Limits of scores in numbers of their kind; what lies beyond every score stays beyond."""
        return x if self.kind is np.int64 else x.clip(-self.bound, self.bound).astype(self.kind)


def _down(x: np.ndarray) -> np.ndarray:
    """What sorts the other way round."""
    return ~x if x.dtype == np.int64 else -x


def _strips(start: int, stop: int) -> Iterator[slice]:
    return (slice(x, min(x + STRIP, stop)) for x in range(start, stop, STRIP))


def _first(s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the n largest of each row and of what equals them, row by row from the largest, of equal ones the first."""
    least = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n, None] if s.shape[1] > n else s.min(1, keepdims=True)
    i, j = np.nonzero(s >= least)
    order = np.lexsort((_down(s[i, j]), i))
    return i[order], j[order]


def _table(parts: list[list], schema: str) -> pa.Table:
    """The columns of all parts, one after another."""
    names = [x.split() for x in schema.split(", ")]
    whole = pa.schema([(n, pa.int32() if t == "int" else pa.int64()) for n, t in names])
    return pa.concat_tables([whole.empty_table(), *(pa.Table.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in p], schema=whole) for p in parts)])


def _positives(most: int) -> Callable:
    """Of a tile of scores each anchor's first other rows of its label."""

    def reduce(one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            return _table([], _FIRST)
        a, b, out = _block(one), _block(two), []
        scores, i = _Scores(a, b), one.column("i")[0].as_py()
        for label in np.unique(b.labels):
            (lo, hi), (c, d) = ([np.searchsorted(x.labels, label, side) for side in ("left", "right")] for x in (a, b))
            for rows in _strips(lo, hi):
                s = scores.of(rows, slice(c, d))
                r, m = _first(s, most + 1)  # itself may be among them
                other = a.rids[rows][r] != b.rids[c:d][m]
                r, m = r[other], m[other]
                some = np.arange(len(r)) - np.searchsorted(r, r) < most
                r, m = r[some], m[some]
                out.append([np.full(len(r), i, np.int32), a.rids[rows][r], a.vec_ids.take(pa.array(rows.start + r)), b.rids[c:d][m], b.vec_ids.take(pa.array(c + m)), s[r, m].astype(np.int64)])
        return _table(out, _FIRST)

    return reduce


def _negatives(most: int, low: int, high: int) -> Callable:
    """Of a tile of scores the first rows of other labels in each window of each anchor."""

    def reduce(one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            return _table([], _FOUND)
        a, b, out = _block(one), _block(two), []
        scores, alone = _Scores(a, b), b.labels[0] == b.labels[-1]
        wins = one.sort_by("k").column("wins").combine_chunks()[0].values
        arid, prid, score = (wins.field(c).to_numpy() for c in ("arid", "prid", "score"))
        bounds = [(-(-low * x // 100), high * x // 100) for x in score.tolist()]
        there = np.flatnonzero([x <= y and x < 1 << 63 and y >= -1 << 63 for x, y in bounds])
        by = np.argsort(a.rids)
        own = by[np.searchsorted(a.rids[by], arid[there])]  # the anchor of a window
        order = np.argsort(own, kind="stable")
        there, own = there[order], own[order]
        floor, top = (scores.limit(np.array([min(max(bounds[w][x], -1 << 63), (1 << 63) - 1) for w in there.tolist()], np.int64)) for x in (0, 1))
        spans = [(0, np.searchsorted(a.labels, b.labels[0])), (np.searchsorted(a.labels, b.labels[0], "right"), len(a.labels))] if alone else [(0, len(a.labels))]
        for rows in (x for span in spans for x in _strips(*span)):
            w = slice(*np.searchsorted(own, (rows.start, rows.stop)))
            if w.start == w.stop:
                continue
            s, n, mine, least, last = scores.of(rows, slice(0, len(b.rids))), rows.stop - rows.start, own[w] - rows.start, floor[w], top[w]
            lowest, highest = scores.limit(np.full(n, (1 << 63) - 1)), scores.limit(np.full(n, -1 << 63))
            np.minimum.at(lowest, mine, least)
            np.maximum.at(highest, mine, last)
            r, m = np.nonzero((s >= lowest[:, None]) & (s <= highest[:, None]))
            if not alone:
                other = a.labels[rows][r] != b.labels[m]
                r, m = r[other], m[other]
            v = s[r, m]
            order = np.lexsort((b.place[m], _down(v), r))
            r, m, v = r[order], m[order], v[order]
            # a window's rows begin at the first of its anchor that is no larger than its top
            steps = np.unique(_down(v))
            where = lambda anchor, x: anchor * (len(steps) + 1) + np.searchsorted(steps, _down(x))  # noqa: B023, E731
            at = np.searchsorted(where(r, v), where(mine, last))[:, None] + np.arange(most)
            fine = at < len(r)
            at = np.where(fine, at, 0)
            if len(r):
                fine &= (r[at] == mine[:, None]) & (v[at] >= least[:, None])
            k, x = np.nonzero(fine)
            at, k = at[k, x], there[w][k]
            anchors, rivals = rows.start + r[at], m[at]
            out.append([a.rids[anchors], a.vec_ids.take(pa.array(anchors)), prid[k], wins.field("pid").take(pa.array(k)), score[k], b.rids[rivals], b.vec_ids.take(pa.array(rivals)), v[at].astype(np.int64)])
        return _table(out, _FOUND)

    return reduce


def mine(rows: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the hardest negatives of every anchor and positive.

    ``rows`` has vec_id, label, v (array<bigint>) and anchor (boolean). A row's score is its
    inner product with the anchor, in int64 (modulo 2^64 beyond that); where one vector is
    longer the other counts zeros. An anchor's positives are its first ``positives`` other
    rows of its label; a positive's negatives are the first ``negatives`` rows of other
    labels with low * positive_score <= 100 * negative_score <= high * positive_score.
    Higher scores come first, then the smaller vec_id, a missing one last. Repeated rows are
    rows of their own, as anchors too. Rows without a label take no part. An empty table gives
    an empty result; other columns are ignored. A long vector has more chunks. A tile holds one
    block and one chunk, however many rows share a label or a vector; a task holds two blocks
    and a strip of scores, so its memory stays as the table grows.
    """
    held = cut(in_small_batches(rows).where("label is not null").select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", "v", "anchor"), "vectors")
    group = F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int")
    sums = (F.count("*"), F.sum(F.size("v")), F.count_if("anchor"), F.sum(F.when(F.col("anchor"), F.size("v"))))
    found = {r["g"]: [x or 0 for x in r[1:]] for r in held.groupBy(group.alias("g")).agg(*sums).collect()}  # GROUPS rows at most
    n_b = [max(-(-n // ROWS), -(-cells // CELLS)) for n, cells, *_ in (found.get(g, (0, 0)) for g in range(GROUPS))]
    from_b = np.cumsum([0, *n_b]).tolist()
    n_a = max(1, -(-sum(x[2] for x in found.values()) // ANCHORS), -(-sum(x[3] for x in found.values()) // CELLS))

    def of(values) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), group + 1)

    def dealt(n) -> Column:
        return F.pmod(F.xxhash64("rid"), F.greatest(n, F.lit(1)))

    b_tiles = cut(tiles(held, (of(from_b[:GROUPS]) + dealt(of(n_b))).cast("int")), "tiles")
    a_tiles = cut(tiles(held.where("anchor"), dealt(F.lit(n_a)).cast("int")), "anchor_tiles")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    parts = min(2 * n_a * max(from_b[-1], 1), 4096)  # a task has few pairs of blocks, whatever their bytes

    def scored(a: DataFrame, work: Callable, schema: str) -> DataFrame:
        left = a.select(F.col("block").alias("i"), every(from_b[-1]).alias("j"), "k", "rids", "vec_ids", "labels", "m", F.when(F.col("k") == 0, F.col("wins")).alias("wins"))
        right = b_tiles.select(every(n_a).alias("_i"), F.col("block").alias("_j"), "k", "rids", "vec_ids", "labels", "m")
        return left.repartition(parts, "i", "j").groupBy("i", "j").cogroup(right.repartition(parts, "_i", "_j").groupBy("_i", "_j")).applyInArrow(work, schema)

    place = F.expr("row_number() over (partition by arid order by positive_score desc, positive_id asc nulls last, prid)")
    first = cut(scored(a_tiles.withColumn("wins", F.lit(None).cast(_WINS)), _positives(positives), _FIRST).withColumn("place", place).where(F.col("place") <= positives), "positives")
    wins = first.groupBy(F.col("i").alias("block")).agg(F.collect_list(F.struct("arid", "prid", F.col("positive_id").alias("pid"), F.col("positive_score").alias("score"))).alias("wins"))
    rank = F.expr("row_number() over (partition by arid, prid order by negative_score desc, negative_id asc nulls last, nrid)").cast("int")
    found_ = cut(scored(a_tiles.join(wins, "block"), _negatives(negatives, low, high), _FOUND).withColumn("rank", rank).where(F.col("rank") <= negatives), "negatives")
    forget(held, a_tiles, b_tiles, first)
    return found_.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11(embeddings: DataFrame) -> DataFrame:
    """``mine`` over a table of (vec_id, embedding, label): a label moves by one where vec_id is divisible by 7, anchors are the rows whose vec_id is divisible by 100."""
    rows = quantised(embeddings)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", moved.alias("label"), "v", F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)).alias("anchor")))


def oracle() -> str:
    """The rows of ``op11`` in DuckDB SQL: every anchor's inner product with every row; for vectors of one length."""
    return """
    WITH used AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT a.rid AS arid, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM used a JOIN used b ON a.vec_id % 100 = 0 AND a.rid <> b.rid),
    positives AS (SELECT arid, anchor_id, rid AS prid, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id NULLS LAST, rid) <= 5),
    ranked AS (SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.arid, p.prid ORDER BY s.score DESC, s.vec_id NULLS LAST, s.rid) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
      FROM positives p JOIN scored s ON p.arid = s.arid AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
    SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5"""
