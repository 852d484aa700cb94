"""Hard negatives, resampling and suffixes against plain versions, on small tables with nulls, ties, repeats, long and empty values."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from shoebox.llm import negatives, resampling, suffixes

DOCS = "doc_id bigint, text string, lang string, key string, rid int, rank double, bucket string"


def with_clashes(spark, rows):
    return spark.createDataFrame([(i, t, "en", "clash", 1, 0.5, "clash") for i, t in rows], DOCS).repartition(5)


# suffixes


def plain_removed(rows):
    """(n_bytes, removed places) of each row, all strings of 100 bytes by a dictionary of their earliest start."""
    raw = [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for doc, b in raw:
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            first[s] = min(first.get(s, (doc, p)), (doc, p))
    out = []
    for doc, b in raw:
        off = [False] * len(b)
        for p in range(len(b) - 99):
            if first[b[p : p + 100]] < (doc, p):
                off[p : p + 100] = [True] * 100
        spans = sum(off[k] and not (k and off[k - 1]) for k in range(len(off)))
        out.append((len(b), sum(off), spans, hashlib.sha256(bytes(x for x, o in zip(b, off, strict=True) if not o)).hexdigest()))
    return out


def repetitive(seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(40)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, base = prose(40), prose(300)
    edited = base.split(" ")
    edited[100] = "changed"
    texts = [prose(rng.randrange(0, 200)) for _ in range(15)] + [prose(10) + passage + prose(i) for i in range(12)] + [base, base, " ".join(edited), base[50:400], base[:99], base[:100], base[:101]]
    texts += [passage[k : k + 130] for k in range(0, 60, 7)] + [passage + passage, "a" * 350, "ab" * 200, "xyz" * 40 + "a" * 150, "\0" * 130, "\0" * 99 + "q" * 5, None, "", "short", "日本語" * 60, prose(2000) + passage]
    ids = [None, None, *range(3, len(texts) + 1)]
    rng.shuffle(ids)
    return [*zip(ids, texts, strict=True), (500, passage + "!"), (500, passage + "!"), (500, "?" + passage)]


@pytest.mark.parametrize(("bucket", "hot"), [(7, 3), (20, suffixes.HOT), (suffixes.BUCKET, 1)])
def test_suffixes_against_all_strings(spark, bucket, hot):
    rows = repetitive(bucket)
    got = suffixes.remove_repeats(with_clashes(spark, rows), bucket=bucket, hot=hot).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got) == sorted((str(i), *x) for (i, _), x in zip(rows, plain_removed(rows), strict=True))
    assert all(sum(r.spans[1::2]) == r.n_removed == r.n_bytes - len(r.kept) and len(r.spans) == 2 * r.n_spans for r in got)


def test_suffixes_carry_columns_and_take_an_empty_table(spark):
    df = with_clashes(spark, [(1, "x" * 120), (2, "y")])
    got = suffixes.remove_repeats(df, carry=("key", "rank")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.key, r.n_removed) for r in got] == [(1, "clash", 119), (2, "clash", 0)]
    assert suffixes.remove_repeats(df.where("false")).count() == 0


def test_anchors_are_decided_by_the_string_alone():
    rng = random.Random(3)
    for letters in ("ab", "abcdefgh", "a"):
        s = bytes(rng.choice(letters.encode()) for _ in range(100))
        for _ in range(20):
            one, two = (bytes(rng.choice(letters.encode()) for _ in range(rng.randrange(0, 300))) for _ in range(2))
            text = one + s + two
            found = suffixes.anchors(suffixes.grams(text + bytes(7)), np.array([len(text)])) - len(one)
            own = suffixes.anchors(suffixes.grams(s + bytes(7)), np.array([100]))
            assert len(own) == 1 and own[0] in found and own[0] < suffixes.SPREAD


def test_multikey_sort_and_common_bytes():
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 30))) for _ in range(300)]
    order, common = suffixes.multikey_sort(suffixes.characters(texts, 30))
    filled = [texts[i].ljust(32, b"\0") for i in order]
    assert filled == sorted(filled)
    for a, b, c in zip(filled, filled[1:], common[1:], strict=False):
        assert c == next((k for k in range(32) if a[k] != b[k]), 32)


# resampling


def plain_resample(rows, target, percent=10, least=20):
    from re import split

    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return [w for w in split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low) if w]

    number = lambda w: zlib.crc32(w.encode()) % 10_000
    s, t = [0] * 10_000, [0] * 10_000
    for _, x in rows:
        for w in words(x):
            s[number(w)] += 1
    for x in target:
        for w in words(x):
            t[number(w)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, x in rows:
        own = words(x)
        weight = math.floor(Fraction(sum(gain[number(w)] for w in own), len(own))) if own else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return out


@pytest.fixture(scope="module")
def prose_rows():
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdEé日1") for _ in range(rng.randrange(1, 7))) for _ in range(200)]
    prose = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(n))
    texts = [prose(rng.randrange(0, 60)) for _ in range(300)] + [prose(30)] * 80 + [None, "", " ,. \n", prose(20_000)]
    rows = [(None if k in (5, 390) else k // 2, t) for k, t in enumerate(texts)]
    return [*rows, rows[5], rows[100]], [prose(30) for _ in range(20)]


def test_resampling_against_a_plain_version(spark, prose_rows):
    rows, target = prose_rows
    aim = spark.createDataFrame([(i, t) for i, t in enumerate([*target, None])], "item_id bigint, text string")
    got = [tuple(r) for r in resampling.resample(with_clashes(spark, rows), aim).collect()]
    want = [tuple(r) for r in plain_resample(rows, target)]
    # equal rows share their place among each other, whichever has the lower rank
    assert sorted(map(str, got)) == sorted(map(str, want))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", list(enumerate(target)))
    assert sorted(map(str, con.sql(resampling.oracle()).fetchall())) == sorted(map(str, want))


def test_resampling_of_empty_tables(spark, prose_rows):
    rows, _ = prose_rows
    df, aim = with_clashes(spark, rows), spark.createDataFrame([], "item_id bigint, text string")
    assert sorted(str(tuple(r)) for r in resampling.resample(df, aim).collect()) == sorted(str(tuple(r)) for r in plain_resample(rows, []))
    assert resampling.resample(df.where("false"), aim).count() == 0
    few = resampling.resample(df.where("doc_id = 7"), aim).collect()
    assert len(few) == 2 and {r["rank"] for r in few} == {None}


def test_features_of_several_words(spark):
    row = spark.createDataFrame([("a b c",), ("",)], "text string").select(resampling.features(resampling.words_of(resampling.F.col("text")), 3).alias("f")).collect()
    assert sorted(row[0].f) == ["a", "a b", "a b c", "b", "b c", "c"] and row[1].f == []


# hard negatives


def plain_mine(rows):
    """Every anchor against every row, in whole Python numbers."""
    used = [(k, i, (l + 1) % 10 if i is not None and i % 7 == 0 else l, [math.floor(256 * float(x)) for x in v]) for k, (i, v, l) in enumerate(rows) if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, i, label, v in used:
        if i is None or i % 100:
            continue
        first = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), j is None, j or 0, m, other == label) for m, j, other, w in used if m != k))  # noqa: B905
        scored = [(-s, None if none else j, same) for s, none, j, m, same in first]
        for ps, pid, _ in [x for x in scored if x[2]][:5]:
            fit = [(s, j) for s, j, same in scored if not same and 80 * ps <= 100 * s <= 100 * ps][:5]
            out += [(i, pid, r + 1, j, ps, s) for r, (s, j) in enumerate(fit)]
    return out


def embedding_rows(seed, n=900, dims=70):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    rows = [(int(i), (centres[i % 6] + 0.6 * rng.normal(size=dims)).astype(np.float32).tolist(), int(i % 4)) for i in range(n)]
    rows += [(n + k, rows[10][1], k % 3) for k in range(40)] + [(400, rows[3][1], 2), (400, rows[3][1], 2), (None, rows[4][1], 1), (None, rows[4][1], 1)]
    rows += [(2000, None, 1), (2100, rows[5][1], None), (2200, [float("nan")] * dims, 1), (2300, [float("inf")] * dims, 1), (2400, [None] * dims, 1), (2500, [], 1), (2600, [0.5, 1.5], 1), (2700, rows[6][1] + [2.0] * 40, 1), (2800, [-x for x in rows[7][1]], 3), (2900, rows[8][1], 77)]
    return rows


VECTORS = "vec_id bigint, embedding array<float>, label int, rid string, block string"


@pytest.mark.parametrize("small", [True, False])
def test_negatives_against_a_plain_version(spark, monkeypatch, small):
    if small:
        for name, n in (("ROWS", 50), ("ANCHORS", 6), ("STRIP", 2)):
            monkeypatch.setattr(negatives, name, n)
    rows = embedding_rows(int(small))
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], VECTORS).repartition(4)
    got = [tuple(r) for r in negatives.op11(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_mine(rows))) and len(got) > 50
    assert negatives.op11(df.where("false")).count() == 0
    assert negatives.op11(df.where("vec_id % 100 <> 0")).count() == 0


def test_negatives_in_sql(spark):
    rows = [r for r in embedding_rows(3) if r[1] is None or len(r[1]) == 70]
    got = negatives.op11(spark.createDataFrame([(*r, "", "") for r in rows], VECTORS)).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    assert sorted(map(str, con.sql(negatives.oracle()).fetchall())) == sorted(str(tuple(r)) for r in got)


def test_products_beyond_doubles():
    a = np.array([[2**40, 3] + [0] * 30, [1] * 32])
    assert (negatives._times(a, a) == a @ a.T).all()
    assert (negatives._times(a[1:], a[1:]) == 32).all()
