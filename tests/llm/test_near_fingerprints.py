"""The fingerprint step of near dedup: what the trie brings together, and that its links count without the shingle join."""

import random

from shoebox.llm import near


def test_pairs_are_of_fingerprints_within_three_bits(spark):
    nodes = [(1, 0), (2, 0), (3, 0b111), (4, 0b1111 << 20), (5, -1), (6, -1), (7, 0b1111111 << 40)]
    found = near.fingerprint_pairs(spark.createDataFrame(nodes, "node bigint, fp bigint"))
    assert sorted((r.u, r.v) for r in found.collect()) == [(1, 2), (1, 3), (5, 6)]
    assert near.fingerprint_pairs(spark.createDataFrame([], "node bigint, fp bigint")).count() == 0


def test_trie_links_near_copies_by_itself(spark, monkeypatch):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(9000)}" for _ in range(6000)) for _ in range(6)]
    texts = [t for b in base for t in (b, b + " one", b + " other end")] + [None, "", "short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(near, "shared_lists", lambda *_: spark.createDataFrame([], "sig bigint, node bigint, n int, pos int"))
    found = {r.doc_id: r.component_id for r in near.near_components(docs).collect()}
    assert [found[i] for i in range(18)] == [i - i % 3 for i in range(18)]
    assert [found[i] for i in range(18, 21)] == [18, 18, 20]
