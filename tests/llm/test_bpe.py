import hashlib
import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shoebox.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
THEIRS = Tokenizer.from_file(PATH)
OURS = bpe.PairIndexBPE(PATH)


def check(texts):
    known = {}
    for t, got in zip(texts, OURS.encode(texts, known), strict=True):
        want = THEIRS.encode(t, add_special_tokens=False).ids
        assert got == want, repr(t)
        assert OURS.decode(got) == THEIRS.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(texts):
    check(texts)


def test_hard_cases():
    rng = random.Random(3)
    check([
        "", " ", "  \n\n a", "aaaaaaaaa" * 50, "can't we'LL they've  x", "<|endoftext|>a<|endoftext|> <|endoftext|", "é" * 300, "naïve 日本語 👩‍👩‍👧 1234567",
        "\x1c\x1d a\x85b᠎​　c\x00", "".join(chr(rng.choice([32, 10, 97, 0xE9, 0x4E2D, 0x1F600])) for _ in range(3000)), "x" * 20000,
    ])


def test_operator(spark):
    texts = ["Hello there, it's 10 past 9.", None, "", "Hello there, it's 10 past 9.", "<|endoftext|>", "word " * 30000]
    docs = spark.createDataFrame([(i % 4, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens string")
    want = []
    for i, t in enumerate(texts):
        ids = THEIRS.encode(t or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i % 4, len(ids), sha(",".join(map(str, ids))), sha(THEIRS.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.round_trip(docs, PATH).collect())) == sorted(want)
    assert sorted((r.doc_id, r.text) for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()) == sorted((i % 4, t or "") for i, t in enumerate(texts))
    assert bpe.round_trip(docs.where("false"), PATH).count() == 0
