"""Words that a worker has met, and their merges."""

import json
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from shoebox.llm import merges, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_words_outlast_a_full_memory(monkeypatch):
    """A word met lately is not merged again because others have filled the memory, nor for the mark behind it."""
    monkeypatch.setattr(packing, "REMEMBERED", 12)
    words, asked = packing.WordTokenizer(PATH), []
    merge = words.merges.encode
    monkeypatch.setattr(words.merges, "encode", lambda some: asked.extend(some) or merge(some))
    theirs = Tokenizer.from_file(PATH)
    for text in ("alpha beta gamma delta", "one two three four five", "alpha, beta. Gamma*** delta", "five (six) it's", "alpha's beta", "five six,"):
        assert words.encode([text])[0].tolist() == theirs.encode(text, add_special_tokens=False).ids
    assert len(asked) == len(set(asked))
    assert len(words.known) + len(words.older) <= 40


def test_every_pair_has_its_rank():
    held = json.load(open(PATH, encoding="utf-8"))["model"]
    table, vocab = merges.MergeTable(PATH), held["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in held["merges"]]
    a, b = (np.array([vocab[p[k]] for p in pairs], np.int32) for k in (0, 1))
    assert (table._rank(a, b) == np.arange(len(pairs))).all()
    there = set(zip(a.tolist(), b.tolist(), strict=True))
    found = table._rank(a, b[::-1])
    assert [r < merges._NONE for r in found.tolist()] == [p in there for p in zip(a.tolist(), b[::-1].tolist(), strict=True)]


def test_words_of_all_widths_equal_the_library():
    rng = random.Random(6)
    parts = "in th er an re tion é ou aux ê ch sch ung a aa aaa x ž".split()
    texts = [w for w in ("".join(rng.choice(parts) for _ in range(rng.randint(1, 16))) for _ in range(4000)) if len(w.encode()) <= 40]
    assert {len(w.encode()) for w in texts} >= set(range(1, 36))
    theirs = Tokenizer.from_file(PATH)
    assert [x.tolist() for x in packing.WordTokenizer(PATH).encode(texts)] == [x.ids for x in theirs.encode_batch(texts, add_special_tokens=False)]
