"""Removal of byte strings that start earlier, by sorted suffixes.

A suffix array of every byte would be many times the corpus, so only suffixes that some
local rule picks are sorted. Of the SPREAD grams at the head of each WIDTH-byte string the
one of least hash is its anchor (the first of equal ones): the string alone decides it, so
equal strings have their anchors at the same place, with CONTEXT bytes behind it inside
the string. Three narrowing steps precede the sort:

- anchors whose CONTEXT bytes stand nowhere else are left;
- the span of an anchor is all that strings with this anchor can cover. Where an equal
  span starts earlier, all of it goes, by one row for some thirty bytes;
- what is left are the first ones of each span; where only one span has these CONTEXT
  bytes there is nothing to compare.

The remaining suffixes - around edits and the ends of repeated passages - are dealt into
ranges of their leading bytes by sampled splitters. A bucket sorts its suffixes, and what
lies before them reversed, by multikey quicksort over characters of eight bytes, and reads
from the common prefixes of neighbours which strings are equal. Suffixes of equal CONTEXT
bytes stay in one bucket unless they are more than HOT; those are parted by all their bytes,
and the strings that the runs at a bucket's two ends have are compared once more across all
buckets - but for strings that begin farther before the anchor than any two of them agree,
which another sort, by the bytes before it, tells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import byte_texts, cut, forget, in_small_batches
from shoebox.llm.substring import _SETTLED, _by_row, _run_lists, _settled, _texts, _unrun

WIDTH = 100
GRAM, CONTEXT = 8, 40
#: Grams among which an anchor is picked: the last of them still has CONTEXT bytes in the string.
SPREAD = WIDTH - CONTEXT + 1
BEFORE = SPREAD - 1
#: Suffixes of a bucket, about, and the windows that are looked at together, whose numbers fit PLACE bits.
BUCKET = 50_000
PLACE = 22
#: Suffixes of equal CONTEXT bytes that a bucket takes whole.
HOT = 4096
_MASK = np.uint64((1 << PLACE) - 1)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ENTRY = "right binary, back binary, doc_id bigint, rid bigint, at int, hot boolean"


def grams(text: bytes) -> np.ndarray:
    """The eight bytes at every place, as a number."""
    n = len(text) - GRAM + 1
    return np.ndarray((max(n, 0),), "<u8", text, strides=(1,)).astype(np.uint64)


def anchors(g: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The anchors of all strings of WIDTH bytes that lie within one of the texts, which end at ``ends`` of their joined bytes."""
    sizes = np.diff(np.r_[0, ends])
    inside = np.repeat(ends, sizes) - np.arange(int(ends[-1]) if len(ends) else 0) >= WIDTH
    found = []
    for lo in range(0, max(len(inside) - WIDTH + 1, 0), 1 << (PLACE - 1)):
        part = g[lo : lo + (1 << (PLACE - 1)) + SPREAD - 1]
        keyed = part * _M1
        keyed ^= keyed >> np.uint64(32)
        keyed *= _M2
        keyed &= ~_MASK
        keyed |= np.arange(len(part), dtype=np.uint64)
        width = 1
        while 2 * width <= SPREAD:
            keyed = np.minimum(keyed[:-width], keyed[width:])
            width *= 2
        if width < SPREAD:
            keyed = np.minimum(keyed[: len(keyed) - (SPREAD - width)], keyed[SPREAD - width :])
        at = (keyed & _MASK).astype(np.int64)[: 1 << (PLACE - 1)]
        at = at[inside[lo : lo + len(at)]] + lo
        found.append(at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def contexts(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the CONTEXT bytes at each place."""
    h = np.full(len(at), 0x27D4EB2F165667C5, np.uint64)
    for i in range(0, CONTEXT, GRAM):
        h ^= g[at + i] * _M1
        h = (h << np.uint64(27) | h >> np.uint64(37)) * _M2
        h ^= h >> np.uint64(29)
    return h * _M1


def packed(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """A written table of the texts with a number (rid) each; doc_id is the largest number where there is none."""
    last = (1 << 63) - 1
    rows = in_small_batches(docs).select(F.col("doc_id").cast("bigint").alias("_doc"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"_{c}") for c in carry))
    kept = ["_doc", *(f"_{c}" for c in carry)]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([squeeze.compress(t) for t in byte_texts(b)], pa.binary()), *(b.column(c) for c in kept)], ["packed", *kept])

    done = rows.mapInArrow(pack, "packed binary, " + ", ".join(f"{c} {kinds[c]}" for c in kept))
    return cut(done.select(F.monotonically_increasing_id().alias("rid"), F.coalesce("_doc", F.lit(last)).alias("doc_id"), "packed", *kept), "texts")


def repeated_contexts(texts: DataFrame) -> DataFrame:
    """(rid, at, runs): the anchors whose CONTEXT bytes stand at another anchor too."""

    def pieces(batches):
        for b in batches:
            rid = b.column("rid").to_numpy()
            for s, own in _texts(b):
                sizes = np.array([len(t) for t in own])
                ends, g = np.cumsum(sizes), grams(b"".join(own) + bytes(GRAM - 1))
                at = anchors(g, ends)
                text = np.searchsorted(ends, at, "right")
                yield contexts(g, at), np.zeros(len(at), np.uint64), (at - (ends - sizes)[text]).astype(np.int32), text.astype(np.int32), rid[s], rid[s]

    rows = texts.select("rid", "packed").mapInArrow(lambda batches: _settled(pieces(batches), all_shared=True), _SETTLED)
    # a row of several places tells by itself; a known row's k is its rid, which at worst keeps an anchor to be looked at
    two = F.expr("known or runs is not null or min(rid) over (partition by k) <> max(rid) over (partition by k)")
    return _by_row(rows.select("k", "rid", "at", "runs", "known").withColumn("two", two).where("two").select("rid", "at", "runs"))


def repeated_spans(asked: DataFrame) -> DataFrame:
    """(k, doc_id, rid, at, runs, gone, first) of the repeated anchors: those ``gone`` have an equal span that starts earlier; of others ``first`` is the first place, and all later ones of the row go.

    ``asked`` has rid, doc_id and the packed text with its repeated anchors (at, runs). Spans are compared by two hashes of 64 bits, one of them (k) of the CONTEXT bytes."""

    def pieces(batches):
        for b in batches:
            doc, rid = (b.column(c).to_numpy() for c in ("doc_id", "rid"))
            places = list(zip(b.column("at").to_pylist(), b.column("runs").to_pylist(), strict=True))
            for s, own in _texts(b):
                for i, text, (at, runs) in zip(range(s.start, s.stop), own, places[s], strict=True):
                    at = _unrun(at, runs)
                    spans = np.fromiter((xxhash.xxh3_64_intdigest(text[max(a - BEFORE, 0) : a + WIDTH], min(a, BEFORE)) for a in at.tolist()), np.uint64, len(at))
                    yield contexts(grams(text), at), spans, at.astype(np.int32), np.zeros(len(at), np.int32), doc[i : i + 1], rid[i : i + 1]

    rows = asked.mapInArrow(lambda batches: _settled(pieces(batches), all_shared=False), _SETTLED)
    rows = rows.withColumn("first", F.when(~F.col("known"), F.coalesce("at", F.get("runs", F.lit(0)))))
    # a known row's keys are its rid and zero: should some span have these, its rows are no earlier than a known row, which isn't asked
    gone = F.expr("known or min(if(known, null, struct(doc_id, first))) over (partition by k, k2) < struct(doc_id, first)")
    return rows.withColumn("gone", gone).select("k", "doc_id", "rid", "at", "runs", "gone", "first")


def entries(asked: DataFrame) -> DataFrame:
    """(right, back, doc_id, rid, at, hot): an entry of the suffix array for each of the anchors in ``firsts`` (at, hot), with the bytes from it on and those before it, backwards, that strings can cover."""

    def cut_out(batches):
        for b in batches:
            doc, rid = (b.column(c).to_numpy() for c in ("doc_id", "rid"))
            places = b.column("firsts").to_pylist()
            for s, own in _texts(b):
                for i, text in zip(range(s.start, s.stop), own, strict=True):
                    at, hot = zip(*sorted((x["at"], x["hot"]) for x in places[i]), strict=True)
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([text[a : a + WIDTH] for a in at], pa.binary()), pa.array([text[max(a - BEFORE, 0) : a][::-1] for a in at], pa.binary()), pa.array(np.full(n, doc[i])), pa.array(np.full(n, rid[i])), pa.array(at, pa.int32()), pa.array(hot, pa.bool_())],
                        ["right", "back", "doc_id", "rid", "at", "hot"],
                    )

    return asked.mapInArrow(cut_out, _ENTRY)


def characters(texts: list[bytes], width: int) -> np.ndarray:
    """Texts as rows of numbers of eight bytes each, filled up with zeros, that order as the bytes do."""
    width = -(-width // 8) * 8
    return np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), ">u8").reshape(len(texts), -1).astype(np.uint64)


def multikey_sort(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): how the rows of characters sort, and how many bytes each has in common with the one before.

    Level by level, the rows that are still alike are parted by their next character; who stands alone is left."""
    n, depth = keys.shape
    order, common, group = np.arange(n), np.full(n, 8 * depth, np.int64), np.zeros(n, np.int64)
    common[:1] = 0
    open_ = np.arange(n)
    for level in range(depth):
        c = keys[order[open_], level]
        s = np.lexsort((c, group[open_]))
        order[open_], c, g = order[open_][s], c[s], group[open_]
        if len(open_) < 2:
            break
        new = np.r_[True, (c[1:] != c[:-1]) | (g[1:] != g[:-1])]
        parted = np.flatnonzero(new[1:] & (g[1:] == g[:-1])) + 1
        differ, same = c[parted] ^ c[parted - 1], np.zeros(len(parted), np.int64)
        for byte in range(7):
            same += differ < np.uint64(1) << np.uint64(56 - 8 * byte)
        common[open_[parted]] = 8 * level + same
        number = np.cumsum(new) - 1
        group[open_] = open_[np.flatnonzero(new)][number]
        open_ = open_[(np.bincount(number) > 1)[number]]
    return order, common


def _reaches(batches):
    """Entries with ``reach``: how many bytes before its anchor one shares with another of equal CONTEXT bytes. The neighbours in order of both tell; the ends of a bucket, whose neighbours are elsewhere, may share all."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    keys = [r[:CONTEXT] + b for r, b in zip(table.column("right").to_pylist(), table.column("back").to_pylist(), strict=True)]
    order, common = multikey_sort(characters(keys, CONTEXT + BEFORE))
    shared = np.maximum(common, np.r_[common[1:], 0])
    shared[[0, -1]] = CONTEXT + BEFORE
    reach = np.empty(len(keys), np.int32)
    reach[order] = np.clip(shared - CONTEXT, 0, BEFORE)
    yield from table.append_column("reach", pa.array(reach)).to_batches(max_chunksize=10_000)


def with_reach(found: DataFrame, bucket: int) -> DataFrame:
    """Entries with ``reach``; those that aren't hot are never asked for and have all."""
    hot = found.where("hot")
    parts = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-hot.count() // bucket))
    sorted_ = hot.repartitionByRange(parts, F.substring("right", 1, CONTEXT), "back", "rid", "at").mapInArrow(_reaches, _ENTRY + ", reach int")
    return cut(found.where("not hot").withColumn("reach", F.lit(BEFORE)).unionByName(sorted_), "reaches")


def equal_strings(right: list[bytes], back: list[bytes], rank: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(o, entries, first, edge): for each distance o from a string's start to its anchor the entries that have one, grouped by equal strings; whether each is as early as any of its group; and whether its bytes from the anchor on are those of the least or the largest entry. ``rank`` orders the entries by where they stand."""
    order_r, common_r = multikey_sort(characters(right, WIDTH))
    order_l, common_l = multikey_sort(characters(back, BEFORE))
    size_r, size_l = (np.array([len(x) for x in xs]) for xs in (right, back))
    run_r, run_l = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
    for o in range(SPREAD):
        some = np.flatnonzero((size_l >= o) & (size_r >= WIDTH - o))
        if not len(some):
            continue
        run_r[order_r], run_l[order_l] = np.cumsum(common_r < WIDTH - o), np.cumsum(common_l < o)
        same = run_r[some] * (len(rank) + 1) + run_l[some]
        by = np.lexsort((rank[some], same))
        some, same = some[by], same[by]
        fresh = np.r_[True, same[1:] != same[:-1]]
        first = rank[some][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        ends = run_r[order_r[0]], run_r[order_r[-1]]
        yield o, some, rank[some] == first, np.isin(run_r[some], ends)


def _bucket(batches):
    """The strings of a bucket that start earlier in it, as known rows by rid; and of hot entries at its ends one row for each other string, by two hashes of 64 bits."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    right, back = table.column("right").to_pylist(), table.column("back").to_pylist()
    doc, rid, at = (table.column(c).to_numpy() for c in ("doc_id", "rid", "at"))
    order = np.lexsort((at, doc))
    fresh = np.r_[False, (doc[order][1:] != doc[order][:-1]) | (at[order][1:] != at[order][:-1])]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(fresh)
    reach = np.where(np.asarray(table.column("hot")), np.asarray(table.column("reach")), -1)
    gone_rid, gone_at = [], []
    for o, some, first, edge in equal_strings(right, back, rank):
        gone_rid.append(rid[some[~first]])
        gone_at.append(at[some[~first]] - o)
        ask = some[first & edge & (reach[some] >= o)]
        if len(ask):
            raw = b"".join(xxhash.xxh3_128_digest(back[i][:o][::-1] + right[i][: WIDTH - o]) for i in ask.tolist())
            h = np.frombuffer(raw, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array(doc[ask]), pa.array(rid[ask]), pa.array((at[ask] - o).astype(np.int32)), pa.nulls(len(ask), pa.list_(pa.int32())), pa.array(np.zeros(len(ask), bool))], ["k", "k2", "doc_id", "rid", "at", "runs", "known"])
    gone_rid, gone_at = np.concatenate([[0][:0], *gone_rid]).astype(np.int64), np.concatenate([[0][:0], *gone_at]).astype(np.int64)
    if len(gone_rid):
        by = np.lexsort((gone_at, gone_rid))
        gone_rid, gone_at = gone_rid[by], gone_at[by]
        once = np.r_[True, (gone_rid[1:] != gone_rid[:-1]) | (gone_at[1:] != gone_at[:-1])]
        gone_rid, gone_at = gone_rid[once], gone_at[once]
        rows = gone_rid[np.r_[True, gone_rid[1:] != gone_rid[:-1]]]
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.zeros(len(rows), np.int64)), pa.array(np.zeros(len(rows), np.int64)), pa.array(rows), pa.nulls(len(rows), pa.int32()), _run_lists(gone_at, gone_rid), pa.array(np.ones(len(rows), bool))], ["k", "k2", "doc_id", "rid", "at", "runs", "known"])


def sorted_suffixes(found: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(rid, at, runs): the strings that start earlier, by the places where they start, as far as ``entries`` (a written table) tells."""
    n = found.count()
    parts = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // bucket))
    # repartitionByRange samples the splitters; the number of the row lets them part even equal suffixes, where these are hot
    head = F.substring("right", 1, CONTEXT)
    rows = found.repartitionByRange(parts, head, *(F.when(F.col("hot"), F.col(c)) for c in ("right", "rid", "at"))).mapInArrow(_bucket, _SETTLED)
    gone = F.expr("known or min(if(known, null, struct(doc_id, at))) over (partition by k, k2) < struct(doc_id, at)")
    return rows.withColumn("gone", gone).where("gone").select("rid", "at", "runs")


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = (), bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """Every row of ``docs`` with the bytes that are left: doc_id, n_bytes, n_removed, n_spans, spans, kept (binary), and the columns of ``carry``.

    A byte goes if a string of WIDTH bytes covers it that also starts earlier: in a row of
    smaller doc_id, or in one of the same doc_id at a smaller place. Strings are judged on
    the input and never cross rows. spans lists the removed runs as start, length, start,
    length; what is left need not be UTF-8. A null text has no bytes. Rows without a doc_id
    count as one document after all others, as does a doc_id of 2^63 - 1; rows that repeat
    a doc_id keep what they have at equal places. Other columns are ignored; an empty table
    gives an empty result. A very long text is one row and one task's work, in memory a
    small multiple of its bytes.
    """
    kept = ["_doc", *(f"_{c}" for c in carry)]
    texts = packed(docs, carry)
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}
    again = cut(repeated_contexts(texts), "contexts")
    spans = cut(repeated_spans(texts.select("rid", "doc_id", "packed").join(again, "rid")), "spans")
    forget(again)
    firsts = spans.where("not gone").select("k", "rid", "first")
    several = firsts.groupBy("k").count().where("count > 1").select("k", (F.col("count") > hot).alias("hot"))
    # written, so that the join may part a frequent k over several tasks
    several = cut(several, "several")
    places = firsts.join(several, "k").groupBy("rid").agg(F.collect_list(F.struct(F.col("first").alias("at"), "hot")).alias("firsts"))
    found = cut(entries(texts.select("rid", "doc_id", "packed").join(places, "rid").select("rid", "doc_id", "packed", "firsts")), "entries")
    reached = with_reach(found, bucket)
    strings = cut(sorted_suffixes(reached, bucket), "strings")
    forget(several, found, reached)

    none = F.lit(None)
    later = F.expr("concat(array(runs[0] + 1, runs[1] - 1), slice(runs, 3, greatest(size(runs) - 2, 0)))")
    of_spans = spans.where("gone or runs is not null").select("rid", F.when(F.col("gone"), F.col("at")).alias("at"), F.when(F.col("gone"), F.col("runs")).otherwise(later).alias("runs"), none.cast("int").alias("s_at"), none.cast("array<int>").alias("s_runs"))
    of_strings = strings.select("rid", none.cast("int").alias("at"), none.cast("array<int>").alias("runs"), F.col("at").alias("s_at"), F.col("runs").alias("s_runs"))
    lists = ("at", "runs", "s_at", "s_runs")
    gone = of_spans.unionByName(of_strings).groupBy("rid").agg(*(F.collect_list(c) if c.endswith("at") else F.flatten(F.collect_list(c)) for c in lists)).toDF("rid", *lists)

    def finish(batches):
        for b in batches:
            places = list(zip(*(b.column(c).to_pylist() for c in lists), strict=True))
            for s, own in _texts(b):
                out = [_left(text, _unrun(at, runs), _unrun(s_at, s_runs)) for text, (at, runs, s_at, s_runs) in zip(own, places[s], strict=True)]
                n, removed, runs, left = zip(*out, strict=True)
                part = b.slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(x) // 2 for x in runs], pa.int64()), pa.array(runs, pa.list_(pa.int32())), pa.array(left, pa.binary()), *(part.column(c) for c in kept)],
                    ["n_bytes", "n_removed", "n_spans", "spans", "kept", *kept],
                )

    more = ", ".join(f"{c} {kinds[c]}" for c in kept)
    done = texts.join(gone, "rid", "left").select("packed", *kept, *lists).mapInArrow(finish, f"n_bytes bigint, n_removed bigint, n_spans bigint, spans array<int>, kept binary, {more}")
    return done.select(F.col("_doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "spans", "kept", *(F.col(f"_{c}").alias(c) for c in carry))


def _left(text: bytes, anchored: np.ndarray, strings: np.ndarray) -> tuple[int, int, list[int], bytes]:
    """(bytes, removed bytes, removed runs, what is left) of a text whose spans at ``anchored`` and strings at ``strings`` go."""
    n = len(text)
    if not len(anchored) and not len(strings):
        return n, 0, [], text
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.r_[np.maximum(anchored - BEFORE, 0), strings], 1)
    np.add.at(edge, np.minimum(np.r_[anchored, strings] + WIDTH, n), -1)
    off = np.cumsum(edge[:-1]) > 0
    turns = np.flatnonzero(np.diff(np.r_[False, off, False].astype(np.int8)))
    starts, ends = turns[::2], turns[1::2]
    return n, int(off.sum()), np.stack([starts, ends - starts], 1).ravel().tolist(), np.frombuffer(text, np.uint8)[~off].tobytes()
