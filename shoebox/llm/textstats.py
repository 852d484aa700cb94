"""Counts of one text that several operators use; they work on UTF-8 bytes."""

from __future__ import annotations

import numpy as np

#: What parts words: ASCII white space, as bytes.split() has it.
WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
_CONTINUED = bytes(range(0x80, 0xC0))
_RNG = np.random.default_rng(20240607)
#: Odd multipliers of a window's words; sums of products modulo 2^64 stand for windows until they are compared word by word.
_ODD = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def code_points(text: bytes) -> int:
    return len(text.translate(None, _CONTINUED))


def count_of(text: bytes, characters: bytes) -> int:
    return len(text) - len(text.translate(None, characters))


def window_sums(values: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """A 64-bit sum for each window of ``width`` uint64 values; lanes 0 and 1 have factors of their own."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total += values[i : i + n] * _ODD[i + 30 * lane]
    total ^= total >> np.uint64(29)
    return total * _ODD[63]


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of ``width`` that begins at one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:-1]) > 0


def repeated_words(words: list[bytes], width: int) -> int:
    """How many words lie in windows of ``width`` words that the text has twice or more, the first included."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    return repeated_numbers(ids, len(number), width)


def repeated_numbers(ids: np.ndarray, distinct: int, width: int) -> int:
    """``repeated_words`` of words given as numbers, of which so many are distinct."""
    n = len(ids)
    if n <= width or n - distinct < width:
        return 0  # a repeated window repeats as many words
    ids = ids.astype(np.uint64, copy=False)
    sums = window_sums(ids * _ODD[62] + _ODD[61], width)
    order = np.argsort(sums, kind="stable")
    ranked = sums[order]
    same = np.flatnonzero(ranked[1:] == ranked[:-1])
    if not len(same):
        return 0
    # neighbours of equal sum are compared word by word, so a collision can't count
    a, b = order[same], order[same + 1]
    equal = np.ones(len(same), bool)
    for i in range(width):
        equal &= ids[a + i] == ids[b + i]
    return int(covered(np.unique(np.r_[a[equal], b[equal]]), width, n).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(WHITE)]
    return len(lines) - len(set(lines))
