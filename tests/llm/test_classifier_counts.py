"""Counts of texts worked out by distinct words, and sums over packed n-grams, against plain versions."""

import random

import numpy as np
import pyarrow as pa

from shoebox.llm import classifier
from shoebox.llm import textstats as ts


def plain(text):
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split(b"\n") if x.strip()]
    count = lambda some: sum(c in some for c in text)
    chars = sum(c & 0xC0 != 0x80 for c in text) - count(b" \t\n\r\x0b\x0c")
    return [
        np.log1p(len(words)), np.log1p(chars / n), min(2.0, count(b"#*$%&|<>") / n), min(3.0, count(b".,;:!?") / n),
        sum(65 <= c <= 90 for c in text) / size, count(b"0123456789") / size, len(set(words)) / n, max(map(words.count, words), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, ts.repeated_words(words, 8) / n, 1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))), sum(c > 127 for c in text) / size, float(len(words) < 20), sum(len(w) == 1 for w in words) / n, sum(w.isupper() for w in words) / n,
    ]


def texts():
    rng = random.Random(4)
    words = ["A", "b", "USA", "Usa", "a1", "B2", "\u00c9T\u00c9", "x,", "##", "9", "mn", "mn."]
    said = ["".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\t", "\n\n", " \x0c"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    return [t.encode() for t in [*said, "", " \n ", "one", "a b c d e f g h i " * 3, "same line\nsame line\n" * 9]]


def test_counts_are_those_of_each_text_alone():
    held = texts()
    found = classifier.matrix(held)
    assert np.allclose(found, [plain(t) for t in held], rtol=0, atol=1e-15)
    assert np.array_equal(found, classifier.matrix(held, classifier.spaced_words(held)))
    assert classifier.matrix([]).shape == (0, len(classifier.FEATURES)) and classifier.matrix([b"", b""])[0, 0] == 0


def test_sums_over_packed_grams():
    held = [*texts(), b"x " * 700]
    rows = [classifier.packed(c) for c in classifier.grams(held)]
    columns = [pa.array([b"skipped", *(r[i] for r in rows)], pa.binary()).slice(1) for i in range(4)]
    kinds, (cells, values, ends) = classifier.counted(columns), classifier.unpacked(columns)
    rng = np.random.default_rng(1)
    w, push = rng.normal(size=2 * classifier.CELLS), rng.normal(size=len(held))
    assert np.allclose(classifier.counted_scores(w, kinds), classifier.gram_scores(w, cells, values, ends), atol=1e-4)
    assert np.allclose(classifier.counted_sums(push, kinds), np.bincount(cells, values * np.repeat(push, np.diff(ends)), minlength=len(w)), atol=1e-4)
    empty = classifier.counted([c.slice(0, 0) for c in columns])
    assert classifier.counted_scores(w, empty).tolist() == [] and not classifier.counted_sums(push[:0], empty).any()
