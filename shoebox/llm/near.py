"""Near copies: texts whose SimHash fingerprints meet in the binary trie, and all others of Jaccard similarity 0.8 or more over shingles of five words.

Fingerprints of the sets of shingles are joined by op2's trie, walked in node pairs; what it brings
together is settled on the whole sets, and what they link is one node for all that follows. Of pairs at
0.8 most differ in more bits than a trie can walk, so an exact join finds the rest.

Put the shingles of every text in one order. Two texts that share 0.8 of their shingles then
share one among the first fifth of each, so only that prefix is shuffled. Order is by hash,
with shingles of many texts last; any order finds all pairs, this one keeps lists short.
Texts of one list are first compared with a few of them, then with more; only those that these
links leave in different components are compared pair by pair. A pair is looked at more closely
only where its parity signatures allow it: they differ in no more bits than the sets in shingles.
Every link is settled on the whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import byte_texts, cut, digests, forget, in_small_batches, slices, spaced_words
from shoebox.llm.components import connected_components
from shoebox.llm.simhash import fingerprint_links, majority

#: Words of a shingle; the least similarity is 4/5, of which the whole-number tests below are made.
WIDTH = 5
#: One text in SAMPLE is looked at for shingles of many texts, those of OFTEN texts there or more; FREQUENT of them at most are put last.
SAMPLE, OFTEN, FREQUENT = 32, 4, 500_000
#: Prefix entries in one task.
TASK_ENTRIES = 300_000
#: How many texts of a list all others are compared with, round by round, before all that is left is compared.
STARS = (4, 32)
#: Longs of a parity signature; bytes of text that are hashed together.
SIGNATURE, TOGETHER = 8, 1 << 20
#: Bits of the bitmap that spares texts without candidates the shuffle.
BITMAP = 1 << 23
#: Odd factors by a word's place in its shingle.
_PLACES = np.array([xxhash.xxh64_intdigest(b"", i) | 1 for i in range(WIDTH)], np.uint64)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles; a text of fewer words is one shingle, one without words none."""
    words, codes, offsets = spaced_words([t.lower() for t in texts])
    h = digests(words)[:, 0][codes]
    found = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        n = b - a
        width = min(WIDTH, n)
        mixed = np.full(n - width + 1 if n else 0, n if n < WIDTH else 0, np.uint64)
        for i in range(width):
            mixed += h[a + i : a + i + len(mixed)] * _PLACES[i]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        found.append(np.unique(mixed))
    return found


def shingles(text: bytes) -> np.ndarray:
    return shingle_sets([text])[0]


def signature(held: np.ndarray) -> np.ndarray:
    """Which cells an odd number of the set's shingles fall into, as SIGNATURE longs.

    Two signatures differ in no more bits than the sets in shingles, as each shingle turns one bit.
    """
    odd = np.bincount((held % np.uint64(64 * SIGNATURE)).astype(np.int64), minlength=64 * SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _node(held: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(held.tobytes()) - (1 << 63)


def prefix(held: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 shingles of a set of n, with the sorted ``frequent`` ones last."""
    n = len(held)
    if not n:
        return held
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, held), len(frequent) - 1)
        held = held[np.argsort(frequent[at] == held, kind="stable")]
    return held[: n - (4 * n + 4) // 5 + 1]


def _texts(docs: DataFrame) -> DataFrame:
    return in_small_batches(docs).select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted shingles that a sample of ``docs`` has often. They settle an order only, never a result."""

    def run(batches):
        for b in batches:
            for s in slices(b.column("text"), TOGETHER):
                parts = shingle_sets(byte_texts(b.slice(s.start, s.stop - s.start)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64))], ["sig"])

    sample = _texts(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    often = sample.mapInArrow(run, "sig bigint").groupBy("sig").count().where(F.col("count") >= OFTEN)
    found = often.orderBy(F.desc("count"), "sig").limit(FREQUENT).select("sig").toArrow()
    return np.sort(found.column("sig").to_numpy().astype(np.int64).view(np.uint64))


def _sized(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """(doc_id, node, n, bits, fp) and the columns ``keep`` for every row: its set's name, size, signature and fingerprint."""
    texts = in_small_batches(docs).select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), *(F.col(c).alias(f"_{c}") for c in keep))
    more = "".join(f", _{c} {texts.schema[f'_{c}'].dataType.simpleString()}" for c in keep)

    def run(batches):
        for b in batches:
            for s in slices(b.column("text"), TOGETHER):
                part = b.slice(s.start, s.stop - s.start)
                sets = shingle_sets(byte_texts(part))
                columns = [pa.array([_node(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int32()), pa.array([signature(x) for x in sets], pa.list_(pa.int64())), pa.array([majority(x) for x in sets], pa.int64())]
                kept = [f"_{c}" for c in keep]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, *(part.column(c) for c in kept)], ["doc_id", "node", "n", "bits", "fp", *kept])

    return texts.mapInArrow(run, f"doc_id bigint, node bigint, n int, bits array<bigint>, fp bigint{more}")


def _narrow(x: np.ndarray) -> bytes:
    return x.astype(np.uint16 if x.max(initial=0) < 1 << 16 else np.uint32).tobytes()


def _wide(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, np.uint16 if len(x) == 2 * n else np.uint32).astype(np.int64)


def shared_lists(docs: DataFrame, frequent: np.ndarray, entries: int) -> DataFrame:
    """(sig, node, n, pos): the places of all prefixes' shingles that two nodes or more have.

    Entries are dealt by shingle in packed blocks, of which most are then found to be alone.
    A shingle counts by its part and upper 40 bits; what this brings together besides is settled with the links.
    """
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-entries // TASK_ENTRIES))

    def pack(batches):
        for b in batches:
            for s in slices(b.column("text"), TOGETHER):
                sets = {_node(x): x for x in shingle_sets(byte_texts(b.slice(s.start, s.stop - s.start))) if len(x)}
                if not sets:
                    continue
                firsts = [prefix(x, frequent) for x in sets.values()]
                sizes = np.array([len(x) for x in firsts])
                sig, doc = np.concatenate(firsts), np.repeat(np.arange(len(sizes)), sizes)
                pos = np.arange(len(sig)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                names, n = np.array(list(sets), np.int64), np.array([len(x) for x in sets.values()], np.int32)
                part = (sig % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                out = []
                for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                    docs_, at = np.unique(doc[own], return_inverse=True)
                    upper = (sig[own] >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5]
                    out.append((int(part[own[0]]), upper.tobytes(), _narrow(at), _narrow(pos[own]), names[docs_].tobytes(), n[docs_].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [pa.int32()] + [pa.binary()] * 5, strict=True)], ["part", "sig", "doc", "pos", "node", "n"])

    def meet(batches):
        held: dict[int, list] = {}
        for b in batches:
            for part, sig, doc, pos, node, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                upper = np.zeros((len(sig) // 5, 8), np.uint8)
                upper[:, 3:] = np.frombuffer(sig, np.uint8).reshape(-1, 5)
                at = _wide(doc, len(upper))
                held.setdefault(part, []).append((upper.view(np.int64).ravel() | part, np.frombuffer(node, np.int64)[at], np.frombuffer(n, np.int32)[at], _wide(pos, len(upper)).astype(np.int32)))
        for blocks in held.values():
            sig, node, n, pos = (np.concatenate(x) for x in zip(*blocks, strict=True))
            order = np.lexsort((pos, node, sig))
            sig, node, n, pos = sig[order], node[order], n[order], pos[order]
            new = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]
            sig, node, n, pos = sig[new], node[new], n[new], pos[new]
            same = np.r_[False, sig[1:] == sig[:-1], False]
            keep = np.flatnonzero(same[1:] | same[:-1])
            for i in range(0, len(keep), 1 << 18):
                k = keep[i : i + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(x[k]) for x in (sig, node, n, pos)], ["sig", "node", "n", "pos"])

    packed = _texts(docs).mapInArrow(pack, "part int, sig binary, doc binary, pos binary, node binary, n binary")
    return packed.repartition(parts, "part").mapInArrow(meet, "sig bigint, node bigint, n int, pos int")


def _sets(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, held): the whole sets of the nodes of ``pairs``, and perhaps of some others."""
    both = pairs.select(F.explode(F.array("u", "v")).alias("node"))
    bit = F.pmod(F.col("node"), F.lit(BITMAP))
    words = both.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(pmod(node, {BITMAP}) & 63))")).alias("bits")).toArrow()
    wanted = np.zeros(BITMAP >> 6, np.uint64)
    wanted[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)

    def run(batches):
        for b in batches:
            for s in slices(b.column("text"), TOGETHER):
                sets = [(_node(x), x) for x in shingle_sets(byte_texts(b.slice(s.start, s.stop - s.start)))]
                sets = [(k, x) for k, x in sets if int(wanted[(k % BITMAP) >> 6]) >> (k % 64) & 1]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sets], pa.int64()), _lists([x for _, x in sets])], ["node", "held"])

    return _texts(docs).mapInArrow(run, "node bigint, held array<bigint>").dropDuplicates(["node"])


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) of nodes that their fingerprints (node, fp) bring together.

    Nodes of one fingerprint go with the first of them; firsts go with each other where the trie
    links their fingerprints, each with the least of its class there. So a node has few pairs, however many are alike.
    """
    firsts = cut(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "fingerprints")
    same = nodes.join(firsts.where("n > 1"), "fp").where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    one, two = (firsts.select(F.col("fp").alias(k), F.col("first").alias(f"{k}_first")) for k in "ab")
    far = fingerprint_links(firsts.select("fp")).join(one, "a").join(two, "b")
    far = far.select(F.least("a_first", "b_first").alias("u"), F.greatest("a_first", "b_first").alias("v"))
    held = cut(same.unionByName(far).distinct(), "pairs")
    forget(firsts)
    return held


def _similar(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``pairs`` (u, v) whose sets have a Jaccard similarity of 4/5 or more."""
    sets = _sets(docs, pairs)
    left = sets.select(F.col("node").alias("u"), F.col("held").alias("x"))
    right = sets.select(F.col("node").alias("v"), F.col("held").alias("y"))
    met = pairs.join(left, "u").join(right, "v")
    return met.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("u", "v")


def _apart(total):
    """In how many shingles two similar sets that hold ``total`` together may differ."""
    return total - 2 * F.ceil(4 * total / 9)


def _differ(one: str, two: str):
    """In how many bits two signatures differ."""
    return sum((F.bit_count(F.get(one, F.lit(i)).bitwiseXOR(F.get(two, F.lit(i)))) for i in range(1, SIGNATURE)), F.bit_count(F.get(one, F.lit(0)).bitwiseXOR(F.get(two, F.lit(0)))))


def _pairs(met: DataFrame) -> DataFrame:
    """Distinct pairs (u, v, apart) of lists' entries that may be similar, by their sizes (n, n2) and places (pos, pos2).

    Up to the last place that two sets share, whatever they don't share sets them apart.
    """
    sized = met.where(5 * F.least("n", "n2") >= 4 * F.greatest("n", "n2"))
    each = sized.select(F.least("node", "node2").alias("u"), F.greatest("node", "node2").alias("v"), (F.col("pos") + F.col("pos2") + 2).alias("upto"), _apart(F.col("n") + F.col("n2")).alias("apart"))
    return each.groupBy("u", "v", "apart").agg(F.max("upto").alias("upto"), F.count("*").alias("shared")).where("upto - 2 * shared <= apart").select("u", "v", "apart")


def _signed(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``pairs`` whose signatures don't differ in more bits than similar sets may differ in shingles."""
    one, two = (nodes.select(F.col("node").alias(k), F.col("bits").alias(f"{k}_bits")) for k in "uv")
    return pairs.join(one, "u").join(two, "v").where(_differ("u_bits", "v_bits") <= F.col("apart"))


def near_classes(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, root) and the columns ``keep`` for every row of ``docs``: rows of one root are linked by steps between texts of similarity 4/5 or more.

    Texts are lower-cased in ASCII and parted at white space. Rows of one set of shingles are one
    node, so copies cost one row; null and blank texts are copies of each other. Repeated rows
    stay; rows without a doc_id too. Very long texts are hashed whole; other columns are ignored;
    an empty table gives an empty result.
    """
    rows = cut(_sized(docs, keep), "sizes")
    nodes = rows.groupBy("node").agg(F.any_value("bits").alias("bits"))
    spark = docs.sparkSession
    links = tried = spark.createDataFrame([], "u bigint, v bigint")
    roots = spark.createDataFrame([], "node bigint, root bigint")
    written = []

    def settle(pairs: DataFrame) -> None:
        """The links among ``pairs``, and the roots of all links so far."""
        nonlocal links, tried, roots
        written.append(pairs)
        if pairs.isEmpty():
            return
        written.append(found := cut(_similar(docs, pairs), "links"))
        tried, links = tried.unionByName(pairs), links.unionByName(found)
        if not found.isEmpty():
            roots = connected_components(links.select(F.col("u").alias("a"), F.col("v").alias("b")))

    settle(fingerprint_pairs(rows.where("n > 0").groupBy("node").agg(F.any_value("fp").alias("fp"))))
    entries = rows.agg(F.sum(F.col("n") - F.floor((4 * F.col("n") + 4) / 5) + 1)).first()[0] or 0
    lists = cut(shared_lists(docs, frequent_shingles(docs), entries), "lists")
    for k, stars in enumerate((*STARS, None)):
        at = lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_ = at.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("sig")
        other = ("node", "n", "pos", "root")
        if stars is None:
            # here all meet all of a list, so the signatures go along and decide before a pair is made
            held = cut(at.join(open_, "sig").join(nodes, "node"), "open")
            met = held.join(held.select("sig", *(F.col(c).alias(f"{c}2") for c in (*other, "bits"))), "sig").where("node < node2 and root <> root2")
            met = met.where(_differ("bits", "bits2") <= _apart(F.col("n") + F.col("n2")))
        else:
            # the first of each of so many parts of a list, in an order that each round has anew
            part = F.pmod(F.xxhash64(F.lit(k), "node"), F.lit(stars))
            first = at.groupBy("sig", part.alias("part")).agg(F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), *other)).alias("star"))
            first = first.select(F.col("sig"), *(F.col(f"star.{c}").alias(f"{c}2") for c in other))
            met = at.join(open_, "sig", "left_semi").join(first, "sig").where("root <> root2")
        pairs = _pairs(met) if stars is None else _signed(_pairs(met), nodes)
        pairs = cut(pairs.select("u", "v").join(tried, ["u", "v"], "left_anti"), "pairs")
        if stars is None:
            forget(held)
        settle(pairs)
    forget(lists, *written)
    found = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return found.select("doc_id", "root", *(F.col(f"_{c}").alias(c) for c in keep))


def near_components(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) for every row of ``docs``: the least doc_id of its class by ``near_classes``.

    A null doc_id names a component only where all of it are null.
    """
    rows = near_classes(docs)
    return rows.join(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")
