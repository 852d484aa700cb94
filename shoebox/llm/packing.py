"""Best-fit packing of tokenized texts into sequences of bounded length, in rounds.

Each task packs its own pieces best-fit: the longest first, each into the bin that it fills
best. Bins that are nearly full are done. The others become items themselves: their numbers
and sizes travel to fewer tasks, which pack them best-fit into each other, and so on up a
tree until one task has met all that is left. A round writes which bin went into which, and
where; the pieces stay where they were written and are told their sequence at the end.
"""

from __future__ import annotations

import json
import os
import re
import string
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import coded_words, cut, gathered, in_small_batches, slices
from shoebox.llm.merges import MergeTable

#: The id that closes a text; the share of the capacity from which a bin is done.
END, NEARLY = 1, 0.995
#: Words after which a worker begins a new memory, keeping the last; tasks whose leftovers meet in one; items that one task packs together.
REMEMBERED, FAN_IN, TASK_ITEMS = 300_000, 8, 50_000
#: Bytes of text that are tokenized together.
TOGETHER = 4 << 20
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


#: Texts of these characters alone are cut into words here; they are their own NFC and lower-case letter by letter.
_PLAIN = re.compile("[\\t\\n\\r -~\u00a1-\u012f\u0131-\u017f]*")
#: Fixed value: how the tokenizer parts the words of a lower-cased text.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Neither space nor letter nor number: at the end of a word they are one part together.
_MARKS = string.punctuation


#: Fixed value: the tokenizer's own rules, which the two patterns above restate.
RULES = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _PARTS.pattern}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
]


def rules_of(held: dict) -> list:
    """The normalizer and pre-tokenizer of a tokenizer file."""
    return [held["normalizer"], held["pre_tokenizer"]]


class WordTokenizer:
    """Token ids, as little-endian uint32 bytes, of texts whose words can't affect each other.

    The tokenizer drops white space and no token spans it, so a text's ids are its words'
    ids one after another; a worker remembers the ids of words that it has met and merges
    new ones together. Other texts, and those that hold a special token, are left whole to
    the tokenizers library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        if (found := rules_of(held)) != RULES:
            raise ValueError(f"{path} cuts texts by other rules: {found}")
        self.path, self.tokenizer = path, None
        self.special = [t["content"] for t in held["added_tokens"]]
        self.merges = MergeTable(path, held)
        # ids of words and of their parts: those met lately, and those met before them
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        if self.tokenizer is None:  # only a worker that meets such a text loads the library's model
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Enter words, and the parts they are made of, into the memory; a part is merged once."""
        known, older = self.known, self.older
        made, parts = [], set()
        for w in new:
            if w.isalpha():
                parts.add(w)
            elif w in older:
                known[w] = older[w]
            else:
                head = w.rstrip(_MARKS)
                m = (head, w[len(head) :]) if head.isalpha() else _PARTS.findall(w)
                made.append((w, m))
                parts.update(m)
        parts = [p for p in parts if p not in known]
        known.update((p, older[p]) for p in parts if p in older)
        fresh = [p for p in parts if p not in older]
        known.update(zip(fresh, self.merges.encode([p.encode() for p in fresh]), strict=True))
        long = [p for p in fresh if known[p] is None]
        known.update(zip(long, self.whole(long), strict=True))
        for w, m in made:
            known[w] = b"".join([known[p] for p in m])

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of each word."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {"": b""}, self.known
        found = list(map(self.known.get, words))
        new = [k for k, ids in enumerate(found) if ids is None]
        self._learn([words[k] for k in new])
        for k in new:
            found[k] = self.known[words[k]]
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as little-endian uint32."""
        plain = [_PLAIN.fullmatch(t) is not None and not any(s in t for s in self.special) for t in texts]
        words, codes, offsets = coded_words(pa.array([t.lower().replace("\n", " ") for t, p in zip(texts, plain, strict=True) if p], pa.string()))
        own = self._known(words)
        flat = np.frombuffer(b"".join(own), "<u4")
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        starts = np.cumsum(sizes) - sizes
        ids = gathered(flat, starts[codes], sizes[codes])
        ends = np.r_[0, np.cumsum(sizes[codes])][offsets]
        easy = iter([ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
        hard = iter([np.frombuffer(x, "<u4") for x in self.whole([t for t, p in zip(texts, plain, strict=True) if not p])])
        return [next(easy) if p else next(hard) for p in plain]


_LOADED: dict[str, WordTokenizer] = {}


def load(path: str) -> WordTokenizer:
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def tokenized(batches, path: str, capacity: int):
    """(doc_id, piece, start, length, ids_crc32) as lists, for every piece of every text: its ids and END, cut after each ``capacity``."""
    closed = np.array([END], "<u4")
    words = load(path)
    for b in batches:
        for s in slices(b.column("text"), TOGETHER):
            part = b.slice(s.start, s.stop - s.start)
            rows = []
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), words.encode([t or "" for t in part.column("text").to_pylist()]), strict=True):
                ids = np.concatenate([ids, closed])
                for k, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at : at + capacity]
                    rows.append((doc_id, k, at, len(own), zlib.crc32(own)))
            yield [list(x) for x in zip(*rows, strict=True)]


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins, as lists of places in ``sizes``: the largest first, each into the bin with the least room that takes it."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    rooms: dict[int, list[int]] = defaultdict(list)  # room -> bins with it
    held = 0  # a bit for each room that a bin has
    bins: list[list[int]] = []
    for i in order:
        size = sizes[i]
        fit = held >> size
        if fit:
            room = size + ((fit & -fit).bit_length() - 1)
            at = rooms[room].pop()
            if not rooms[room]:
                held ^= 1 << room
            bins[at].append(i)
        else:
            room, at = capacity, len(bins)
            bins.append([i])
        left = room - size
        if left:
            rooms[left].append(at)
            held |= 1 << left
    return bins


def _placed(sizes: np.ndarray, capacity: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, used) of each item, packed best-fit; bins are numbered from ``base``."""
    bin_, offset, used = (np.zeros(len(sizes), np.int64) for _ in range(3))
    for k, members in enumerate(best_fit(sizes.tolist(), capacity)):
        own = sizes[members]
        bin_[members], offset[members], used[members] = base + k, np.cumsum(own) - own, own.sum()
    return bin_, offset, used


def _numbers(level: int) -> int:
    """The first number for bins of this task in this round."""
    return (level << 56) | (TaskContext.get().partitionId() << 32)


def _first_round(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """Every piece with its bin, its offset there, and what the bin holds in all."""

    def run(batches):
        base = _numbers(0)
        held: list[list] = [[] for _ in range(5)]

        def pack():
            nonlocal base, held
            bin_, offset, used = _placed(np.array(held[3], np.int64), capacity, base)
            base = int(bin_.max()) + 1
            columns = [pa.array(x, t) for x, t in zip(held, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            held = [[] for _ in range(5)]
            whole = pa.RecordBatch.from_arrays([*columns, pa.array(bin_), pa.array(offset), pa.array(used)], ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "used"])
            yield from (whole.slice(i, 10_000) for i in range(0, whole.num_rows, 10_000))

        for rows in tokenized(batches, path, capacity):
            for own, more in zip(held, rows, strict=True):
                own += more
            if len(held[0]) >= TASK_ITEMS:
                yield from pack()
        if held[0]:
            yield from pack()

    texts = in_small_batches(docs).select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return texts.mapInArrow(run, f"{PIECES}, bin bigint, offset bigint, used bigint")


def _next_round(items: DataFrame, level: int, capacity: int) -> DataFrame:
    """(item, bin, offset, used): where each item (item, size) went, and what the bin holds in all."""

    def run(batches):
        base, held = _numbers(level), []

        def pack():
            nonlocal base, held
            item, size = (np.concatenate(x) for x in zip(*held, strict=True))
            held = []
            bin_, offset, used = _placed(size, capacity, base)
            base = int(bin_.max()) + 1
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (item, bin_, offset, used)], ["item", "bin", "offset", "used"])

        for b in batches:
            held.append((b.column("item").to_numpy(), b.column("size").to_numpy()))
            if sum(len(x) for x, _ in held) >= TASK_ITEMS:
                yield from pack()
        if held:
            yield from pack()

    return items.select("item", "size").mapInArrow(run, "item bigint, bin bigint, offset bigint, used bigint")


def pack(docs: DataFrame, path: str, capacity: int = 4096, least_gain: float = 0.01) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only a text of more than ``capacity`` tokens, END included, is cut. A null or empty
    text is one piece of END alone. sequence_id may be any number; offset is gapless from 0
    in each sequence. Repeated rows and rows without a doc_id are packed as others; other
    columns are ignored; an empty table gives an empty result; a very long text is many
    pieces. Each round writes its moves, so a lost executor costs a round at most. Rounds go
    on until all that is left has met in one task; where that is more than a task takes in,
    until a round lessens the bins by less than the share ``least_gain``.
    """
    placed = cut(_first_round(docs, path, capacity), "pieces")
    full, task = int(NEARLY * capacity), F.shiftright("bin", 32)
    bins = placed.where(F.col("used") < full).groupBy("bin").agg(F.max("used").alias("used"))
    moves: list[DataFrame] = []
    tasks = 0
    while True:
        n, met = bins.agg(F.count("*"), F.count_distinct(task)).first()
        if n < 2:
            break
        least = -(-n // TASK_ITEMS)
        # the tasks of the round before count as they were asked for, so the rounds are a logarithm of the first one's
        tasks = max(least, min(tasks or met, met) // FAN_IN)
        # bins of all sizes meet: they are dealt in turn, in the order of a hash, and their number is exact without a key
        items = bins.select(F.col("bin").alias("item"), F.col("used").alias("size")).repartition(tasks)
        moves.append(cut(_next_round(items, len(moves) + 1, capacity), "moves"))
        bins = moves[-1].where(F.col("used") < full).groupBy("bin").agg(F.max("used").alias("used"))
        if tasks == 1 or tasks == least and bins.count() > (1 - least_gain) * n:
            break
    # from the last round down: a bin that moved on stands for its place in a sequence
    where = None
    for m in reversed(moves):
        m = m.select("item", "bin", "offset")
        if where is not None:
            m = m.join(where, "bin", "left").select("item", F.coalesce("sequence_id", "bin").alias("bin"), (F.col("offset") + F.coalesce("at", F.lit(0))).alias("offset"))
        where = m.select(F.col("item").alias("bin"), F.col("bin").alias("sequence_id"), F.col("offset").alias("at"))
    if where is None:
        return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
    found = placed.join(where, "bin", "left")
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("at", F.lit(0))).alias("offset"))
