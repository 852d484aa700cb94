"""Byte-pair merges of many short words at once, as steps over a matrix of symbols."""

from __future__ import annotations

import json

import numpy as np

from shoebox.llm.bpe import byte_symbols

#: Words of more bytes than this are left to the library; words merged together.
LONGEST, TOGETHER = 32, 1 << 15
_NONE = np.int32(2**31 - 1)
#: Slots of a table of pairs, as a power of 2; an odd factor that scatters the pairs.
_BITS, _FACTOR = 18, 0x9E3779B97F4A7C15


class MergeTable:
    """The merges of a ``tokenizers`` BPE file over byte symbols, with an optional word-end suffix."""

    def __init__(self, path: str, held: dict | None = None):
        """``held`` is the file's content where it is at hand."""
        if held is None:
            with open(path, encoding="utf-8") as f:
                held = json.load(f)
        model = held["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int32)
        self.last = np.array([vocab[c + suffix] for c in symbols], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.out = np.array([vocab[a + b] for a, b in pairs], np.int32)
        # a table has slots for keys and their ranks; of keys that share a slot all but the first go to the next table
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        rest = np.arange(len(keys))[::-1]
        while len(rest):
            slots = self._slots(keys[rest], len(self.tables))
            held, ranks = np.full(1 << _BITS, -1, np.int64), np.full(1 << _BITS, _NONE, np.int32)
            held[slots], ranks[slots] = keys[rest], rest
            self.tables.append((held, ranks))
            rest = rest[held[slots] != keys[rest]]

    @staticmethod
    def _slots(keys: np.ndarray, table: int) -> np.ndarray:
        odd = np.uint64((_FACTOR * (2 * table + 1)) % (1 << 64))
        return ((keys.view(np.uint64) * odd) >> np.uint64(64 - _BITS)).view(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NONE where it has none."""
        key = (a.astype(np.int64) * self.size + b).ravel()
        found, some = np.full(len(key), _NONE, np.int32), slice(None)
        for table, (held, ranks) in enumerate(self.tables):
            slots = self._slots(key, table)
            there = held[slots]
            hit = there == key
            found[some] = np.where(hit, ranks[slots], _NONE)
            # only a key whose slot another one has can be in the next table
            more = np.flatnonzero(~hit & (there >= 0))
            if not len(more):
                break
            key, some = key[more], more if isinstance(some, slice) else some[more]
        return found.reshape(a.shape)

    def _merge(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids) of rows of as many symbols each: a step applies each row's least rank, leftmost first, so all rows lose a symbol."""
        n, width = ids.shape
        ends = np.full(n, width)
        if width < 2:
            return ids, ends
        live, a, r = np.arange(n), ids, self._rank(ids[:, :-1], ids[:, 1:])
        while True:
            best = r.argmin(1)
            least = r[np.arange(len(live)), best]
            open_ = least < _NONE
            if not open_.all():
                done = live[~open_]
                ids[done, : a.shape[1]], ends[done] = a[~open_], a.shape[1]
                live, a, r, best, least = live[open_], a[open_], r[open_], best[open_], least[open_]
                if not len(live):
                    return ids, ends
            rows, made, width = np.arange(len(live)), self.out[least], a.shape[1] - 1
            gone = np.ones(a.shape, bool)
            gone[rows, best + 1] = False
            a = a[gone].reshape(-1, width)
            a[rows, best] = made
            if width == 1:
                ids[live, :1], ends[live] = a, 1
                return ids, ends
            # the pair that was merged goes; those beside it get their new ranks
            r = r[gone[:, 1:]].reshape(-1, width - 1)
            some = np.flatnonzero(best < width - 1)
            r[some, best[some]] = self._rank(made[some], a[some, best[some] + 1])
            some = np.flatnonzero(best > 0)
            r[some, best[some] - 1] = self._rank(a[some, best[some] - 1], made[some])

    def encode(self, words: list[bytes]) -> list[bytes | None]:
        """The ids of each word as little-endian uint32 bytes; None for a word of more than LONGEST bytes or none."""
        found: list[bytes | None] = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        order = order[(sizes[order] > 0) & (sizes[order] <= LONGEST)]
        for some in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            for s in range(0, len(some), TOGETHER):
                part = some[s : s + TOGETHER].tolist()
                width = len(words[part[0]])
                raw = np.frombuffer(b"".join([words[i] for i in part]), np.uint8).reshape(-1, width)
                ids = self.inner[raw]
                ids[:, -1] = self.last[raw[:, -1]]
                ids, ends = self._merge(ids)
                flat, step = ids.tobytes(), width * 4
                starts = np.arange(len(part)) * step
                for i, a, b in zip(part, starts.tolist(), (starts + ends * 4).tolist(), strict=True):
                    found[i] = flat[a:b]
        return found
