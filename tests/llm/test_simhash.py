import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shoebox.llm import simhash
from shoebox.llm import components
from shoebox.llm.components import connected_components

SCHEMA = "doc_id bigint, text string, fp string, root int"


def slow_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, budget):
    """Brute force: class of each position."""
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


def test_trie_links_match_brute_force():
    rng = random.Random(1)
    keys = {rng.getrandbits(64) for _ in range(200)}
    for base in list(keys)[:20]:
        x = base
        for _ in range(30):  # chains and balls of near keys
            x = x ^ (1 << rng.randrange(64)) if rng.random() < 0.5 else base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
            keys.add(x)
    keys = sorted(keys)
    assert list(simhash.trie_links(np.array(keys, np.uint64), 0, 3)) == classes(keys, 3)


def test_trie_links_of_one_large_ball():
    keys = sorted({0} | {1 << i | 1 << j for i in range(64) for j in range(i)})
    assert not simhash.trie_links(np.array(keys, np.uint64), 0, 3).any()


def test_operator_against_brute_force(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("Ab cd ef gh ij kl mn op qr".split()) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts = base + [t + " end" for t in base] + ["x " * 5000 + t for t in base[:5]] + [None, "", " \n", "Été Word", "a b"] + base[:10]
    rows = [(i * 7 % 1009, t, "clash", 3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op2(docs).collect()}
    fps = [slow_fingerprint(r[1]) for r in rows]
    root = classes(fps, 3)
    least = {}
    for r, c in zip(rows, root):
        least[c] = min(least.get(c, 1 << 60), r[0])
    assert got == {r[0]: (f"{f:016x}", least[c]) for r, f, c in zip(rows, fps, root)}


def test_nulls_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(None, None, "", 1), (4, "", "", 1), (4, "", "", 1), (2, "one two three", "", 1)], SCHEMA)
    got = sorted(simhash.op2(docs).collect(), key=str)
    assert [(r.doc_id, r.component_id) for r in got if r.fingerprint == "0" * 16] == [(4, 4), (4, 4), (None, 4)]
    assert len(got) == 4
    assert simhash.op2(docs.where("false")).count() == 0


@pytest.mark.parametrize("n", [2, 40])
@pytest.mark.parametrize("small", [0, 50_000])
def test_components_of_paths_and_hubs(spark, n, small, monkeypatch):
    monkeypatch.setattr(components, "SMALL", small)
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, n)] + [(5000, 5000), (None, 3)]
    got = {(r.node, r.root) for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {(i, 0) for i in range(1, n + 1)} | {(1000 + i, 1000) for i in range(1, n)}


def test_trie_budget_other_than_three(spark):
    fps = spark.range(64).select(F.expr("shiftleft(1L, int(id))").alias("fp"))
    links = simhash.fingerprint_links(fps, budget=2)
    assert connected_components(links).select("root").distinct().count() == 1
    assert simhash.fingerprint_links(fps, budget=1).count() == 0
