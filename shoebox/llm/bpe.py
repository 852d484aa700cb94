"""Byte-level BPE encoding and decoding by a pair occurrence index.

A task takes the new pre-tokens of a batch together as one long row of symbols, maps
each adjacent pair that has a merge rank to all its positions, and applies the active
ranks in ascending order: every position of the pair with the least active rank is
merged, left to right, and only the lists of the neighbouring pairs change. A merge
makes a symbol that only later ranks can use, so no rank returns once it is done, and
the outcome is that of merging each pre-token alone, least rank first.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import coded_words, in_small_batches, slices

#: Fixed value: how byte-level tokenizers of this family cut a text into pre-tokens.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where a space can't be taken for the start of a pre-token of its own text, and the marks that encode_parts uses.
_APART = regex.compile(r" \s|\s |^ | $|[\x01\x02]")
_BESIDE = ("  ", " \n", "\n ")
#: Characters that make the closer look of _APART needed: white space other than space and newline, and the marks.
_RARE = frozenset("\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000\x01\x02") | frozenset(map(chr, range(0x2000, 0x200B)))
#: Stretches of text that a worker remembers.
REMEMBERED = 200_000


def byte_symbols() -> list[str]:
    """The character that stands for each byte in the vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def parts_at_spaces(text: str) -> bool:
    """Whether every space of a text starts a pre-token or is one, and no mark is in the way."""
    if text[:1] == " " or text[-1:] == " " or any(x in text for x in _BESIDE):
        return False
    return _RARE.isdisjoint(text) or _APART.search(text) is None


class PairIndexBPE:
    """Encoder and decoder for a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        vocab = held["model"]["vocab"]
        symbols = byte_symbols()
        byte_of = {c: b for b, c in enumerate(symbols)}
        self.byte_ids = [vocab[c] for c in symbols]
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(held["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[vocab[a], vocab[b]] = (r, vocab[a + b])
        self.width = max(vocab.values()) + 2
        pairs = sorted((p[0] * self.width + p[1], r) for p, (r, _) in self.rank.items())
        self.keys, self.key_ranks = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.byte_array = np.array(self.byte_ids, np.int64)
        self.pair_of = {r: (*p, out) for p, (r, out) in self.rank.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pattern = regex.compile(PRE_TOKENS)
        self.decimal = {i: str(i) for i in self.bytes_of}

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each pre-token; all are merged together, rank by rank, through the pair occurrence index."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        raw = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        ids = self.byte_array[raw]
        ids[ends] = -1  # no pair reaches across
        n = len(ids)
        left, right = np.arange(-1, n - 1), np.arange(1, n + 1)
        right[-1] = n - 1
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray) -> None:
            """Enter the pairs that begin at these places into the index."""
            ranks = self._ranks(ids[at], ids[right[at]])
            at, ranks = at[ranks >= 0], ranks[ranks >= 0]
            if not len(at):
                return
            if len(at) == 1:
                groups = [(int(ranks[0]), at)]
            else:
                order = np.argsort(ranks, kind="stable")
                at, ranks = at[order], ranks[order]
                cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                groups = zip(ranks[np.r_[0, cuts]].tolist(), np.split(at, cuts), strict=True)
            for r, some in groups:
                if r not in places:
                    places[r] = [some]
                    heapq.heappush(active, r)
                else:
                    places[r].append(some)

        note(np.arange(n - 1))
        while active:
            r = heapq.heappop(active)
            a, b, out = self.pair_of[r]
            lists = places.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = at[(ids[at] == a) & (ids[right[at]] == b)]  # an earlier merge may have taken it
            if len(lists) > 1 or a == b:
                at = np.unique(at)
            if a == b and len(at) > 1:
                at = self._apart(at, right)
            if not len(at):
                continue
            j = right[at]
            ids[at], ids[j] = out, -2
            k = right[j]
            right[at] = k
            left[k] = at
            before = left[at]
            before = before[before >= 0]
            # a place can be both before one merge and one itself
            note(np.unique(np.concatenate([before, at])))
        keep = ids != -2
        counts = np.add.reduceat(keep, np.r_[0, ends[:-1] + 1]) - 1 if len(words) else np.zeros(0, np.int64)
        flat = ids[keep & (ids != -1)]
        return np.split(flat, np.cumsum(counts)[:-1]) if len(words) else []

    @staticmethod
    def _apart(at: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of places whose pairs overlap, in a run of one symbol, every second from the left."""
        follows = right[at[:-1]] == at[1:]
        first = np.r_[True, ~follows]
        since = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        return at[since % 2 == 0]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it has none."""
        key = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.key_ranks[at], -1)

    def split(self, text: str) -> list[str]:
        """Pre-tokens and special tokens of a text, in order."""
        if self.cut is None or not any(t in text for t in self.special):
            return self.pattern.findall(text)
        found = []
        for k, part in enumerate(self.cut.split(text)):
            found += [part] if k % 2 else self.pattern.findall(part)
        return found

    def encode_parts(self, texts: pa.Array, known: dict) -> tuple[list, np.ndarray, np.ndarray]:
        """(pieces, codes, offsets): the distinct pieces of the texts, and each text as a run of codes of them.

        A piece is what ``known``, a memory between calls, holds of a stretch of text that
        no pre-token crosses: (number of ids, the ids in decimal, the bytes they decode to).
        A text is parted before each space where that holds, which is wherever no other
        white space stands beside the space.
        """
        texts = texts.to_pylist()
        plain = [parts_at_spaces(t) and not any(s in t for s in self.special) for t in texts]
        # \x01 marks the word that begins a text, as it has no space before it; \x02 a text that is parted otherwise
        words, codes, offsets = coded_words(pa.array(["\x01" + t if p else "\x02" for t, p in zip(texts, plain, strict=True)], pa.string()))
        hard = [["\x01" + x for x in self.split(t)] for t, p in zip(texts, plain, strict=True) if not p]
        new = [w for w in words if w not in known]
        new += {x for parts in hard for x in parts if x not in known}
        if len(known) + len(new) > REMEMBERED:
            kept = {w: known[w] for w in words if w in known} | {x: known[x] for parts in hard for x in parts if x in known}
            known.clear()
            known.update(kept)
        self._learn(new, known)
        found = [known[w] for w in words]
        if hard:
            # the texts that aren't parted at spaces: their pre-tokens follow as pieces of their own
            place = {x: len(found) + k for k, x in enumerate(dict.fromkeys(x for m in hard for x in m))}
            found += [known[x] for x in place]
            runs = iter([np.array([place[x] for x in m], np.int64) for m in hard])
            each = [codes[a:b] if p else next(runs) for p, a, b in zip(plain, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            codes, offsets = np.concatenate(each), np.r_[0, np.cumsum([len(x) for x in each])]
        return found, codes, offsets

    def _learn(self, words: list[str], known: dict) -> None:
        """Enter words into the memory; a word without the mark \x01 has a space before it."""
        made = []
        for w in words:
            x = w[1:] if w[:1] == "\x01" else " " + w
            made.append([x] if x in self.special else self.pattern.findall(x) if w != "\x02" else [])
        parts = list({p for m in made for p in m} - self.special.keys())
        said = dict(zip(parts, (x.tolist() for x in self.encode_words([p.encode() for p in parts])), strict=True)) if parts else {}
        said |= {t: [i] for t, i in self.special.items()}
        text, raw = self.decimal, self.bytes_of
        for w, m in zip(words, made, strict=True):
            ids = said[m[0]] if len(m) == 1 else [i for p in m for i in said[p]]
            known[w] = (len(ids), ",".join([text[i] for i in ids]), b"".join([raw[i] for i in ids]))

    def encode(self, texts: list[str], known: dict | None = None) -> list[list[int]]:
        """The ids of each text; ``known`` is a memory of stretches of text between calls."""
        found, codes, offsets = self.encode_parts(pa.array(texts, pa.string()), {} if known is None else known)
        ids = [[int(i) for i in said.split(",") if i] for _, said, _ in found]
        codes = codes.tolist()
        return [[i for c in codes[a:b] for i in ids[c]] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, tuple[PairIndexBPE, dict]] = {}


def load(path: str) -> tuple[PairIndexBPE, dict]:
    """One encoder and one memory for a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = (PairIndexBPE(path), {})
    return _LOADED[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text. Null and empty texts have no ids."""

    def run(batches):
        bpe, known = load(path)
        for b in batches:
            for s in slices(b.column("text")):
                part = b.slice(s.start, s.stop - s.start)
                ids = pa.array(bpe.encode([t or "" for t in part.column("text").to_pylist()], known), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return in_small_batches(docs).select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""

    def run(batches):
        bpe, _ = load(path)
        for b in batches:
            texts = [bpe.decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("bigint"), "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, in one pass.

    The digest of a text's ids and of what they decode to; a pre-token's part of both is
    worked out once a task. Null and empty texts have no tokens; repeated rows stay, a
    null doc_id stays, other columns are ignored, an empty table gives an empty result.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        bpe, known = load(path)
        for b in batches:
            for s in slices(b.column("text")):
                part = b.slice(s.start, s.stop - s.start)
                found, codes, offsets = bpe.encode_parts(pc.fill_null(part.column("text"), ""), known)
                counts = np.r_[0, np.cumsum(np.fromiter((x[0] for x in found), np.int64, len(found))[codes])]
                runs = [codes[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                said, decoded = [x[1] for x in found], [x[2] for x in found]
                ids_sha, text_sha = [], []
                for run_ in runs:
                    run_ = run_.tolist()
                    # only a stretch without ids, the empty text, has an empty part
                    ids_sha.append(hashlib.sha256(",".join([said[c] for c in run_ if said[c]]).encode()).hexdigest())
                    raw = b"".join([decoded[c] for c in run_])
                    text_sha.append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
                n = counts[offsets[1:]] - counts[offsets[:-1]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return in_small_batches(docs).select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)
