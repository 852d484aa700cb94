"""Lanes, lists, runs, bytes and queues against plain versions."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from shoebox.functions.binary import as_doubles
from shoebox.operators import display, queue


def plain_lanes(faces, width, most=3):
    """faces: (id, x, name)."""
    if not width:
        return {f[0]: 0 for f in faces}
    ends, out = [], {}
    for i, x, name in sorted(faces, key=lambda f: (f[1], f[0])):
        start = x / width * 100
        end = start + min(62, (len(name or "Nicht zugewiesen") * 6.2 + 34) / 420 * 100)
        at = next((k for k, e in enumerate(ends) if e <= start), None)
        if at is None:
            if len(ends) < most:
                ends.append(0)
                at = len(ends) - 1
            else:
                at = ends.index(min(ends))
        ends[at] = max(ends[at], end)
        out[i] = at
    return out


def test_lanes(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for image in range(40):
        width = rng.choice([0, None, 400, 1000, 3000])
        faces = [(image * 100 + k, rng.choice([0.0, 10.0, rng.uniform(0, 1000)]), rng.choice([None, "", "Al", "Maximiliane von Irgendwo"])) for k in range(rng.randrange(1, 12))]
        rows += [(image, i, x, n, width) for i, x, n in faces]
        want |= plain_lanes(faces, width)
    df = spark.createDataFrame(rows, "image_id bigint, id bigint, bbox_x double, person_name string, natural_width int")
    assert {r.id: r.lane for r in display.label_lanes(df).collect()} == want and set(want.values()) == {0, 1, 2}


def test_lists_keep_their_order(spark):
    current = spark.createDataFrame([(5, 0), (3, 1), (9, 2), (3, 7)], "id bigint, place int")
    page = spark.createDataFrame([(7, 0, "g"), (9, 1, "i"), (1, 2, "a"), (5, 3, "e")], "id bigint, place int, name string")
    assert [(r.id, r.name, r.known) for r in display.merged_list(current, page).orderBy("n").collect()] == [(5, "e", True), (9, "i", True), (7, "g", False), (1, "a", False)]


@pytest.mark.parametrize("keys", ["aab", "", "a", "aaaaaaaaaa", "abababab"])
def test_runs(spark, keys):
    rng = random.Random(keys)
    rows = [(i, None if k == "b" and i % 5 == 0 else k) for i, k in enumerate(keys * 20)]
    shuffled = rng.sample(rows, len(rows))
    got = display.runs(spark.createDataFrame(shuffled, "n int, k string").repartition(7), "k", "n").orderBy("n").collect()
    want, run = [], -1
    for j, (_, k) in enumerate(rows):
        run += j == 0 or k != rows[j - 1][1]
        want.append(run)
    assert [r.run for r in got] == want


def test_doubles_of_bytes(spark):
    rng = random.Random(2)
    special = [0.0, -0.0, 1.0, -1.5, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, math.inf, -math.inf, math.nan, math.pi]
    raw = [struct.pack("<d", x) for x in special] + [rng.randbytes(8) for _ in range(2000)]
    df = spark.createDataFrame([(i, b, float(i), i) for i, b in enumerate(raw)] + [(-1, None, None, None)], "i int, b binary, d double, n int")
    got = {r.i: r for r in as_doubles(df, "b", "d", "n").collect()}
    for i, b in enumerate(raw):
        (x,) = struct.unpack("<d", b)
        assert (math.isnan(x) and math.isnan(got[i].b)) or struct.pack("<d", got[i].b) == b
    assert got[-1].b is None and got[3].n == 3.0
    with pytest.raises(TypeError):
        as_doubles(df.withColumn("s", F.lit("x")), "s")
    with pytest.raises(Exception, match="eight bytes"):
        as_doubles(spark.createDataFrame([(b"123",)], "b binary"), "b").collect()


def test_queues(spark):
    rows = [("a", 1, "running", "2024-01-01", 0, 30.0), ("a", 2, "running", "2024-01-02", 1, 50.0), ("a", 3, "queued", None, 2, 100.0), ("a", 4, "queued", None, 3, 5.0), ("a", 5, "completed", None, 9, 1.0),
            ("b", 6, "paused", "2024-01-01", 0, 3.0), ("b", 7, "queued", None, 1, 3.0), ("c", 8, "queued", None, 5, 2.4), ("c", 9, "queued", None, 4, 1.0), ("d", 10, "running", "2024-01-01", 0, None), ("d", 11, "queued", None, 1, 1.0), ("e", 12, "failed", None, 1, 1.0), ("f", 13, "running", "2024-01-01", 0, 9.0), ("f", 14, "queued", None, 1, 1.0)]
    df = spark.createDataFrame(rows, "queue string, id bigint, status string, started_at string, place int, seconds double").withColumn("started_at", F.col("started_at").cast("timestamp"))
    got = {r.id: (r.position, r.eta, r.overall_eta) for r in queue.snapshot(df, 2).collect()}
    assert got == {1: (None, 30.0, 130), 2: (None, 50.0, 130), 3: (1, 130.0, 130), 4: (2, 55.0, 130), 5: (None, None, 130), 6: (None, None, None), 7: (1, None, None), 8: (2, 2.4, 2), 9: (1, 1.0, 2), 10: (None, None, None), 11: (1, None, None), 12: (None, None, None), 13: (None, 9.0, 9), 14: (1, 1.0, 9)}
    held = {r.queue: tuple(r)[1:] for r in queue.counts(df).collect()}
    assert held["a"] == (2, 2, 0, 1, 1) and held["b"] == (1, 1, 1, 0, 6) and held["c"][-1] is None
    stages = spark.createDataFrame([("x", 1, 2.0), ("x", 1, 3.0), ("x", 2, 4.0), ("y", 3, 1.0)], "family string, job int, seconds double")
    assert sorted(map(tuple, queue.family_totals(stages).collect())) == [("x", 2, 9.0, 5.0), ("y", 1, 1.0, 1.0)]


def test_more_waiting_jobs_than_a_recursion_may_have_rows(spark):
    rng = random.Random(3)
    rows = [(q, q * 1000 + i, "queued", i, rng.choice([None, *range(1, 50)]) if q == 1 else rng.randrange(1, 50)) for q in range(3) for i in range(300)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "queue bigint, id bigint, status string, place int, seconds int").withColumn("started_at", F.lit(None).cast("timestamp"))
    want = {}
    for q in range(3):
        free = [0.0, 0.0]
        for _, i, _, _, s in (r for r in rows if r[0] == q):
            least = min((x for x in free if x is not None), default=None)
            want[i] = None if s is None or least is None else least + s
            if least is not None:
                free[free.index(least)] = want[i]
    held = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        got = {r.id: r.eta for r in queue.ends(df, 2).collect()}
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", held)
    assert got == want
