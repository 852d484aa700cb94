"""Removal of passages that an earlier document has, found by difference-cover anchors.

A match of WINDOW words shows in a shared anchor: a run of ANCHOR words that starts, in
both documents, at a place of the cover. The cover is a set of residues modulo PERIOD such
that any two places have a shift under PERIOD that brings both onto it; so only three of
seven places are hashed, and WINDOW >= PERIOD - 1 + ANCHOR words are enough to hold one.
Places whose anchor another document has too are extended: the windows around them are
hashed whole, in 128 bits, and a window goes where a smaller doc_id has it.

Each task settles first what its own documents tell and passes on one row for each hash
and document, so a passage that thousands share, or that one document repeats, costs a row
per task. Texts are numbered once, in a written table, and travel zstd-compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm import textstats as ts
from shoebox.llm.common import byte_texts, cut, digests, in_small_batches, spaced_words

#: A perfect difference cover: every residue modulo 7 is a difference of two of these.
PERIOD, COVER = 7, (1, 2, 4)
WINDOW = 13
ANCHOR = WINDOW - PERIOD + 1
#: Hashes of one task's round: it settles and passes on what it holds once it holds so many.
ROUND = 300_000
#: Bytes of text that a task looks at together, one text at least.
TOGETHER = 1 << 20
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_RANK = np.cumsum(_IN_COVER) - 1
_SETTLED = "k bigint, k2 bigint, doc_id bigint, rid bigint, at int, runs array<int>, known boolean"


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[slice, list[bytes]]]:
    """The packed texts of a batch, unpacked, about TOGETHER bytes at a time."""
    held, size, first = [], 0, 0
    for i, packed in enumerate(batch.column("packed")):
        held.append(zstandard.decompress(packed.as_py()))
        size += len(held[-1])
        if size >= TOGETHER:
            yield slice(first, i + 1), held
            held, size, first = [], 0, i + 1
    if held:
        yield slice(first, batch.num_rows), held


def _run_lists(at: np.ndarray, group: np.ndarray) -> pa.Array:
    """For each run of equal ``group`` its places, which ascend, as start, length, start, length."""
    if not len(at):
        return pa.array([], pa.list_(pa.int32()))
    fresh = np.r_[True, group[1:] != group[:-1]]
    new = np.flatnonzero(fresh | np.r_[True, at[1:] != at[:-1] + 1])
    pairs = np.stack([at[new], np.diff(np.r_[new, len(at)])], 1).astype(np.int32)
    offsets = np.r_[np.flatnonzero(fresh[new]), len(new)] * 2
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(pairs.ravel()))


def _unrun(at: list[int] | None, runs: list[int] | None) -> np.ndarray:
    """All places of a list and of runs, ascending and once each."""
    pairs = np.asarray(runs or [], np.int64).reshape(-1, 2)
    spread = np.repeat(pairs[:, 0] - np.cumsum(pairs[:, 1]) + pairs[:, 1], pairs[:, 1]) + np.arange(int(pairs[:, 1].sum()))
    return np.unique(np.r_[np.asarray(at or [], np.int64), spread])


def _batch(k, k2, doc, rid, at, runs, known: bool) -> pa.RecordBatch:
    n = len(k)
    at = pa.nulls(n, pa.int32()) if at is None else pa.array(at.astype(np.int32))
    runs = pa.nulls(n, pa.list_(pa.int32())) if runs is None else runs
    return pa.RecordBatch.from_arrays([pa.array(k), pa.array(k2), pa.array(doc), pa.array(rid), at, runs, pa.array(np.full(n, known))], ["k", "k2", "doc_id", "rid", "at", "runs", "known"])


def _settled(pieces, all_shared: bool):
    """The rows that a task passes on, as _SETTLED.

    ``pieces`` are (hash, second hash, place, row, doc_ids by row, rids by row) of some
    documents, rows and places ascending. What a round's own documents settle goes by rid,
    one row of runs for a document, marked as known: with ``all_shared`` every hash of two
    documents, else the hashes of all documents but the least. Of the others one row for
    each hash and document asks the other tasks; of each settled hash so does one row.
    """
    held, size = [], 0

    def settle():
        before = np.cumsum([0] + [len(p[4]) for p in held])
        h, h2, at = (np.concatenate([p[i] for p in held]) for i in range(3))
        row = np.concatenate([p[3] + b for p, b in zip(held, before[:-1], strict=True)])
        doc_of, rid_of = (np.concatenate([p[i] for p in held]) for i in (4, 5))
        order = np.lexsort((h2, h)) if not all_shared else np.argsort(h, kind="stable")
        h, h2, at, row = h[order], h2[order], at[order], row[order]
        docs = doc_of[row]
        fresh = np.r_[True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])]
        starts = np.flatnonzero(fresh)
        group = np.cumsum(fresh) - 1
        least = np.minimum.reduceat(docs, starts)
        if all_shared:
            sure = (least != np.maximum.reduceat(docs, starts))[group]
            asked = ~sure
            small = np.flatnonzero(sure & (docs == least[group]))
            asked[small[np.unique(group[small], return_index=True)[1]]] = True
        else:
            sure = docs > least[group]
            asked = ~sure
        some = np.flatnonzero(asked)
        # the places of one document and hash are one row
        unit = np.cumsum(np.r_[True, (group[some][1:] != group[some][:-1]) | (row[some][1:] != row[some][:-1])]) if len(some) else some
        first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]) if len(some) else some
        count = np.diff(np.r_[first, len(some)])
        one, more = some[first[count == 1]], first[count > 1]
        # in the order of the texts, which leaves little besides the hashes to the shuffle's compression
        one = one[np.argsort(order[one])]
        for s in range(0, len(one), 1 << 16):
            i = one[s : s + (1 << 16)]
            yield _batch(h[i].view(np.int64), h2[i].view(np.int64), docs[i], rid_of[row[i]], at[i], None, False)
        if len(more):
            i, many = some[more], some[np.repeat(count > 1, count)]
            yield _batch(h[i].view(np.int64), h2[i].view(np.int64), docs[i], rid_of[row[i]], None, _run_lists(at[many], np.repeat(np.arange(len(more)), count[count > 1])), False)
        known = np.flatnonzero(sure)
        if len(known):
            known = known[np.lexsort((at[known], row[known]))]
            rows = row[known][np.r_[True, row[known][1:] != row[known][:-1]]]
            yield _batch(rid_of[rows], np.zeros(len(rows), np.int64), doc_of[rows], rid_of[rows], None, _run_lists(at[known], row[known]), True)

    for p in pieces:
        if len(p[0]):
            held.append(p)
            size += len(p[0])
        if size >= ROUND:
            yield from settle()
            held, size = [], 0
    if held:
        yield from settle()


def _by_row(rows: DataFrame) -> DataFrame:
    return rows.groupBy("rid").agg(F.collect_list("at").alias("at"), F.flatten(F.collect_list("runs")).alias("runs"))


def shared_anchors(texts: DataFrame) -> DataFrame:
    """(rid, at, runs): the anchors that another row has too, counted along the cover. Rows of one doc_id and equal hashes of other words may add some; the windows tell."""

    def pieces(batches):
        for b in batches:
            rid = b.column("rid").to_numpy()
            for s, own in _texts(b):
                words, codes, offsets = spaced_words(own)
                sums = ts.window_sums(digests(words)[:, 0][codes], ANCHOR)
                text = np.repeat(np.arange(len(own), dtype=np.int32), np.diff(offsets))[: len(sums)]
                place = np.arange(len(sums)) - offsets[text]
                there = (np.arange(len(sums)) + ANCHOR <= offsets[text + 1]) & _IN_COVER[place % PERIOD]
                place = place[there]
                at = len(COVER) * (place // PERIOD) + _RANK[place % PERIOD]
                yield sums[there], np.zeros(len(at), np.uint64), at.astype(np.int32), text[there], rid[s], rid[s]

    rows = texts.select("rid", "packed").mapInArrow(lambda batches: _settled(pieces(batches), all_shared=True), _SETTLED)
    # a known row's k is its rid: where that is some anchor's hash too, both count as shared, and the windows tell
    two = F.expr("known or min(rid) over (partition by k) <> max(rid) over (partition by k)")
    return _by_row(rows.select("k", "rid", "at", "runs", "known").withColumn("two", two).where("two").select("rid", "at", "runs"))


def covered_windows(asked: DataFrame) -> DataFrame:
    """(rid, at, runs): the windows that a smaller doc_id has too. Only windows around shared anchors are hashed.

    ``asked`` has rid, doc_id and the packed text with its shared anchors (at, runs)."""
    cover = np.array(COVER)

    def pieces(batches):
        for b in batches:
            doc, rid = (b.column(c).to_numpy() for c in ("doc_id", "rid"))
            anchors = list(zip(b.column("at").to_pylist(), b.column("runs").to_pylist(), strict=True))
            for s, own in _texts(b):
                words, codes, offsets = spaced_words(own)
                both = digests(words)[codes]
                for k, (at, runs) in enumerate(anchors[s]):
                    h = both[offsets[k] : offsets[k + 1]]
                    shared = _unrun(at, runs)
                    shared = PERIOD * (shared // len(cover)) + cover[shared % len(cover)]
                    near = np.zeros(len(h) + 1, np.int64)
                    np.add.at(near, np.maximum(shared - (PERIOD - 1), 0), 1)
                    np.add.at(near, shared + 1, -1)
                    at = np.flatnonzero(np.cumsum(near)[: max(0, len(h) - WINDOW + 1)] > 0)
                    lanes = [ts.window_sums(np.ascontiguousarray(h[:, i]), WINDOW, i)[at] for i in (0, 1)]
                    i = s.start + k
                    yield *lanes, at.astype(np.int32), np.zeros(len(at), np.int32), doc[i : i + 1], rid[i : i + 1]

    rows = asked.mapInArrow(lambda batches: _settled(pieces(batches), all_shared=False), _SETTLED)
    # a known row's key is its rid and zero, which no 128-bit hash is taken to be
    gone = F.expr("known or min(doc_id) over (partition by k, k2) < doc_id")
    return _by_row(rows.withColumn("gone", gone).where("gone").select("rid", "at", "runs"))


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``docs`` with what is left of its text: doc_id, text, n_words, n_removed, kept_sha256, and the columns of ``carry``.

    A word goes if a window of WINDOW words covers it whose words also start in a document
    of smaller doc_id; windows are judged on the input. text is the kept words joined by
    one space, or the text as it was where nothing goes; kept_sha256 is that of the joined
    words. Null texts have no words. Rows that share a doc_id never take from each other;
    rows without a doc_id count as the largest of all, as does a doc_id of 2^63 - 1. Repeated
    rows stay; other columns are ignored; an empty table gives an empty result. Very long
    texts are one row and one task's work. Windows are compared by 128-bit hashes of words
    that are themselves hashed in 128 bits.
    """
    last = (1 << 63) - 1
    rows = in_small_batches(docs).select(F.col("doc_id").cast("bigint").alias("_doc"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"_{c}") for c in carry))
    kept = ["_doc", *(f"_{c}" for c in carry)]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for b in batches:
            packed = pa.array([squeeze.compress(t) for t in byte_texts(b)], pa.binary())
            yield pa.RecordBatch.from_arrays([packed, *(b.column(c) for c in kept)], ["packed", *kept])

    more = ", ".join(f"{c} {kinds[c]}" for c in kept)
    packed = rows.mapInArrow(pack, f"packed binary, {more}")
    # the number of a row is settled by the written table
    texts = cut(packed.select(F.monotonically_increasing_id().alias("rid"), F.coalesce("_doc", F.lit(last)).alias("doc_id"), "packed", *kept), "texts")
    anchors = cut(shared_anchors(texts), "anchors")
    # both joins below read the same columns of the same rows by the same key: one exchange serves both
    columns = ("rid", "doc_id", "packed", *kept)
    dealt = texts.where("rid is not null").select(*columns).repartition("rid")
    gone = covered_windows(dealt.join(anchors, "rid").select(*columns, "at", "runs"))

    def finish(batches):
        for b in batches:
            lists = list(zip(b.column("at").to_pylist(), b.column("runs").to_pylist(), strict=True))
            for s, own in _texts(b):
                out = []
                for text, (at, runs) in zip(own, lists[s], strict=True):
                    words = text.split()
                    left = words
                    if at or runs:
                        off = ts.covered(_unrun(at, runs), WINDOW, len(words))
                        left = [w for w, o in zip(words, off.tolist(), strict=True) if not o]
                    joined = b" ".join(left)
                    out.append((text if len(left) == len(words) else joined, len(words), len(words) - len(left), hashlib.sha256(joined).hexdigest()))
                t, n, r, sha = zip(*out, strict=True)
                part = b.slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(sha, pa.string()), *(part.column(c) for c in kept)],
                    ["text", "n_words", "n_removed", "kept_sha256", *kept],
                )

    done = dealt.join(gone, "rid", "left").select(*columns, "at", "runs").mapInArrow(finish, f"text string, n_words bigint, n_removed bigint, kept_sha256 string, {more}")
    return done.select(F.col("_doc").alias("doc_id"), "text", "n_words", "n_removed", "kept_sha256", *(F.col(f"_{c}").alias(c) for c in carry))
