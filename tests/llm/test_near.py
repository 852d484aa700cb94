import random

import numpy as np
import pytest

import corpus_pipeline
from shoebox.llm import near

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def slow_set(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def slow_components(rows):
    """Brute force: the least doc_id that each row reaches."""
    sets, root = [slow_set(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), 1 << 60), d)
    return [least[top(i)] for i in range(len(rows))]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    vocab = [f"Wört{i}" for i in range(300)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    common, texts = " ".join(prose(12)), []
    for _ in range(40):  # copies with single words changed, about the limit of 0.8
        base = prose(rng.randrange(20, 200))
        for _ in range(rng.randrange(1, 6)):
            w = list(base)
            for i in rng.sample(range(len(w)), rng.randrange(0, max(1, len(w) // 25) + 1)):
                w[i] = rng.choice(vocab)
            texts.append(" ".join(w) + (f" {common}" if rng.random() < 0.5 else ""))
    chain = prose(100)
    texts += [" ".join(chain[i : i + 100]) for i in range(0, 1)] + [" ".join(chain[i:] + prose(i)) for i in range(1, 30, 4)]
    texts += ["a b", "A  b", "a b c", "", None, " \n", "a b c d e", "a b c d e f"] + texts[:3]
    ids = rng.sample(range(1000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("stars, often", [((2, 8), 4), ((), 4), ((1,), 1)])
def test_components_are_those_of_brute_force(spark, rows, monkeypatch, stars, often):
    monkeypatch.setattr(near, "STARS", stars)
    monkeypatch.setattr(near, "OFTEN", often)
    monkeypatch.setattr(near, "SAMPLE", 2)
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], SCHEMA).repartition(3)
    got = {r.doc_id: r.component_id for r in near.near_components(docs).collect()}
    want = dict(zip((d for d, _ in rows), slow_components(rows)))
    assert got == want
    assert len(set(want.values())) < len(want) - 40


def test_stage_keeps_one_of_each_component(spark, rows):
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], SCHEMA)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == sorted(set(slow_components(rows)))
    assert corpus_pipeline.near_dedup(spark, docs.where("false"), "").count() == 0


def test_prefix_is_a_fifth_with_frequent_ones_last():
    held = np.arange(1, 11, dtype=np.uint64)
    assert near.prefix(held, np.zeros(0, np.uint64)).tolist() == [1, 2, 3]
    assert near.prefix(held, np.array([1, 3], np.uint64)).tolist() == [2, 4, 5]
    assert len(near.prefix(held[:0], held)) == 0


def test_signatures_never_differ_in_more_than_the_sets():
    rng = np.random.default_rng(3)
    for n in (1, 40, 700):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, 1 + n // 20, dtype=np.uint64)])
        differ = int(np.bitwise_count(near.signature(a) ^ near.signature(b)).sum())
        assert differ <= len(np.setxor1d(a, b)) and (n < 40 or differ > 0)
