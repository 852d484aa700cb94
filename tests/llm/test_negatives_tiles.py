"""Tiles of scores that stay in their task, in every kind of number."""

import random
import time

from shoebox.llm import negatives


def shuffled(spark):
    """Bytes that the session's tasks have written for shuffles so far."""
    time.sleep(1)  # the figures come a little later than the results
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()


def test_no_scores_are_shuffled(spark):
    """Anchors times rows times chunks would be 26 MB here; the vectors are 2 MB."""
    rng = random.Random(8)
    rows = [(i, i % 3, [rng.randrange(-100, 100) for _ in range(256)], i % 4 == 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "vec_id bigint, label bigint, v array<bigint>, anchor boolean")
    before = shuffled(spark)
    assert negatives.mine(df, low=0).count() > 1000
    assert 0 < shuffled(spark) - before < 8 << 20


def wrapped(x):
    return (x + 2**63) % 2**64 - 2**63


def test_kinds_of_numbers(spark):
    """Sums within 2^24, within 2^53 and beyond 2^64, by label."""
    rng = random.Random(9)
    size = [9, 2**15, 2**29, 2**40]
    rows = [(i, i % 4, [rng.randrange(-size[i % 4] // 4, size[i % 4]) for _ in range(rng.choice((40, 70)))], i % 5 == 0) for i in range(160)]
    df = spark.createDataFrame([*rows, (1000, None, [1] * 40, True)], "vec_id bigint, label bigint, v array<bigint>, anchor boolean")
    want = []
    for i, label, v, anchor in rows:
        if anchor:
            scored = sorted((-wrapped(sum(a * b for a, b in zip(v, w, strict=False))), j, other == label) for j, other, w, _ in rows if j != i)
            for p, pid, _ in [x for x in scored if x[2]][:5]:
                fit = [x for x in scored if not x[2] and -10 * p <= -100 * x[0] <= -100 * p][:5]
                want += [(i, pid, n + 1, j, -p, -s) for n, (s, j, _) in enumerate(fit)]
    got = [tuple(r) for r in negatives.mine(df, low=10).collect()]
    assert sorted(got) == sorted(want) and len(got) > 50
