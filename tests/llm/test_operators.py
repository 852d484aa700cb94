"""Every corpus operator against a plain version on a small table with nulls, ties, repeats, long and empty texts."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shoebox.llm import classifier, license, packing, queries, rules, sharding, substring, syncmers, textstats, warc

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, score int, k int, runs string"
SPACE = re.compile("[\x20\x09-\x0d]+")


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = prose(60)
    texts = [prose(rng.randrange(0, 120)) for _ in range(40)] + [prose(10) + " " + shared + " " + prose(i) for i in range(6)] + [shared] * 5
    texts += [None, "", "  \n\t ", "one", "The MIT License\nReleased under the MIT License.", "gnu General-Public License, version 3; APACHE LICENSE", "mit license " * 40, "a b c d e f g h i j " * 30]
    texts += ["x # y\nx # y\n\nx # y\n|||", "\x0b\x1ca\x0c b\x1c", prose(3000), "日本 語 👩 " * 5, "<|endoftext|> a"]
    return [(None if i == 3 else i * 37 % 211, t, rng.choice(["en", None]), rng.choice(["s", "t", None]), 0, "clash", i, i, "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    held = [*rows, rows[1], rows[45]]  # whole rows repeated
    return spark.createDataFrame(held, SCHEMA).repartition(5), held


def as_duck(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    return con


def same(df, con, sql):
    cols = sorted(df.columns)
    want = con.sql(sql)
    at = [want.columns.index(c) for c in cols]
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in want.fetchall())


def test_sharding(docs):
    df, rows = docs
    found = sharding.shard_rows(df, [1.0] * 24)
    same(found, as_duck(rows), sharding.oracle(24))
    got = found.collect()
    assert all(r.grown_shard in (r.shard, 24) for r in got)
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(24))
    assert sharding.shard_rows(df.where("false"), [1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("doc_id"), [1.0, 0.0])


def test_shares_follow_weights(spark):
    got = dict(map(tuple, spark.range(6000).select(sharding.rendezvous(F.col("id"), [1.0, 2.0, 3.0]).alias("s")).groupBy("s").count().collect()))
    assert [abs(got[i] / 1000 - (i + 1)) < 0.15 for i in range(3)] == [True] * 3


def test_license(docs):
    df, rows = docs
    found = license.scan(df)
    same(found, as_duck(rows), license.oracle())
    want = 0
    for _, text, *_ in rows:
        w = [x for x in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        want += sum(w[i : i + len(p)] == p for p in (["mit", "license"], ["apache", "license"], ["general", "public", "license"]) for i in range(len(w)))
    assert found.agg(F.sum("n_base")).first()[0] == want > 40
    assert license.scan(df.where("false")).count() == 0


def test_whole_and_damaged_licence_texts(spark):
    """A template agrees with itself in full, a damaged one in part, a moved or partial one by its key phrase."""
    whole = license._MIT
    words = whole.split()
    damaged = " ".join(w if i < 14 or i % 10 else "other" for i, w in enumerate(words))
    texts = [whole, f"Copyright 2020 a name\n{whole} more", damaged, " ".join(words[:20]), license._gnu("Affero General Public License", "3"), "mit license " * 500, f"{license._BSD_TOP} {license._BSD_NAMES}", "permission is granted",
             "we hope this text may be used to endorse or promote products of ours", "each contributor hereby grants to you a perpetual smile", license._UNLICENSE,
             f"{license._MPL} GNU Lesser General Public License, Apache License version 2.0"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in license.scan(df).collect()}
    assert got[0].labels == got[1].labels == "mit-text" and got[0].score == got[1].score == 1.0
    assert got[2].labels == "mit-text" and 0.85 < got[2].score < 0.95
    assert 0.05 < got[3].score < 0.2
    assert got[4].labels == "agpl,gpl" or "agpl" in got[4].labels and got[4].score == 1.0
    assert got[5].n_base == 500 and got[5].last_word == 998 and "bsd-3-clause" in got[6].labels and (got[7].labels, got[7].score) == ("", 0.0)
    # a key phrase alone gives no label, and the score says how little agrees
    assert [got[i].labels for i in (3, 8, 9)] == [""] * 3 and all(0 < got[i].score < license.LEAST_SHARE for i in (3, 8, 9))
    assert (got[10].labels, got[10].score) == ("unlicense", 1.0) and got[11].labels == "apache,apache-2.0,gpl,lgpl,mpl-2.0"
    same(license.scan(df), as_duck(list(enumerate(texts))), license.oracle())


def test_syncmers(docs):
    df, rows = docs
    got = syncmers.compare(df).collect()
    assert len(got) == len(rows)
    key = lambda r: -(1 << 63) if r[0] is None else r[0]
    ids = sorted({key(r) for r in rows}, reverse=True)
    text = {}
    for r in rows:
        text.setdefault(key(r), r[1] or "")
    want = []
    for r in rows:
        t, after = r[1] or "", text[ids[(ids.index(key(r)) + 1) % len(ids)]]
        half = len(t) // 2
        want.append((str(r[0]), len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    prints = {}
    for r, t in ((r, text[key((r.doc_id,))]) for r in got):
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
    assert syncmers.compare(df.where("false")).count() == 0


def slow_anchors(text, rate, least):
    """[(hash, place)] of a fingerprint, from every k-mer of the text."""
    import xxhash

    def chained(*values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else (v & (2**64 - 1)).to_bytes(8, "little"), seed)
        return seed - (1 << 64) * (seed >> 63)

    words = words_of(text)
    t = [x for w in words for x in (list(w) if len(w) > syncmers.LONG else [w])]
    h, found = [chained(w.encode()) for w in t], {}
    for i in range(len(h) - syncmers.K + 1):
        runs = h[i : i + syncmers.K]
        if min(runs) in (runs[0], runs[-1]):
            found.setdefault(chained(*runs) & 0xFFFFFFFF, i)
    if not found and h:
        whole = 17
        for x in h:
            whole = chained(whole, x)
        return [(whole & 0xFFFFFFFF, 0)]
    return [(d, p) for k, (d, p) in enumerate(sorted(found.items())) if k < least or d < 2**32 // rate]


def slow_likeness(a, b, rate, least):
    if not a and not b:
        return 1.0
    limit = min(2**32 - 1 if rate == 1 or len(x) < least else max(2**32 // rate - 1, x[-1][0]) for x in (a, b))
    a, b = ({d: p for d, p in x if d <= limit} for x in (a, b))
    bins = [(a[d] - b[d]) // syncmers.SLACK for d in a.keys() & b.keys()]
    return 2 * max((bins.count(k) + bins.count(k - 1) for k in bins), default=0) / (len(a) + len(b)) if bins else 0.0


@pytest.mark.parametrize("rate, least", [(syncmers.RATE, syncmers.LEAST), (4, 5), (1, 5)])
def test_fingerprints_and_likeness_by_brute_force(docs, rate, least):
    df, rows = docs
    key = lambda r: -(1 << 63) if r[0] is None else r[0]
    text = {}
    for r in rows:
        text.setdefault(key(r), r[1] or "")
    ids = sorted(text, reverse=True)
    want = []
    for r in rows:
        t = r[1] or ""
        after = text[ids[(ids.index(key(r)) + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, e, n = (slow_anchors(x, rate, least) for x in (t, edited, after))
        want.append(str((r[0], *(" ".join(f"{d:08x}@{p}" for d, p in x) for x in (a, e)), round(slow_likeness(a, e, rate, least), 9), round(slow_likeness(a, n, rate, least), 9))))
    got = syncmers.compare(df, rate, least).collect()
    assert sorted(str((r.doc_id, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))) for r in got) == sorted(want)


def test_sampled_likeness_is_near_the_exact_one():
    rng = random.Random(9)
    worst = 0.0
    for n in (150, 600, 3000):
        words = [f"w{rng.randrange(50_000)}" for _ in range(n)]
        for share in (0.5, 0.8, 0.95):
            # the other text is cut short or has words changed
            other = words[: int(n * share)] if rng.random() < 0.5 else [w if rng.random() < share else "x" + w for w in words]
            exact, some = (slow_likeness(*(slow_anchors(" ".join(x), r, syncmers.LEAST) for x in (words, other)), r, syncmers.LEAST) for r in (1, syncmers.RATE))
            worst = max(worst, abs(exact - some))
    assert worst < 0.15  # a sample of 64 anchors has a deviation of about 0.06


def test_unspaced_and_short_texts_have_many_anchors():
    assert len(slow_anchors("".join(chr(0x4E00 + i * 7 % 900) for i in range(300)), 1, 1)) > 50
    assert len(slow_anchors("a few words only in this one", 1, 1)) >= 3


@pytest.mark.parametrize("rate", [1, syncmers.RATE])
def test_likeness_knows_no_border_of_length(spark, rate):
    """A text against itself cut by some characters, for lengths from a line to some lines: nowhere does a few characters more or less change what is compared."""
    rng = random.Random(8)
    body = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(120))
    for n in range(90, 180, 4):
        a, b = (slow_anchors(body[:m], rate, syncmers.LEAST) for m in (n, n - 4))
        assert slow_likeness(a, b, rate, syncmers.LEAST) > 0.75
    df = spark.createDataFrame([(2, body[:122]), (1, body[:118])], "doc_id bigint, text string")
    assert {r.doc_id: r.near_next for r in syncmers.compare(df, rate).collect()}[2] > 0.9
    # half of a short text is its own still
    df = spark.createDataFrame([(2, body[:130]), (1, body[300:340])], "doc_id bigint, text string")
    assert {r.doc_id: r.near_edited for r in syncmers.compare(df, rate).collect()}[2] > 0.3


def test_syncmers_are_closed_and_context_free(spark):
    rng = random.Random(1)
    body = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    df = spark.createDataFrame([(0, body), (1, "other words first " + body)], "i int, t string").select("i", F.explode(syncmers.anchors(F.col("t"))).alias("a"))
    held = {i: {(r[0], r[1]) for r in df.where(f"i = {i}").select(syncmers.digest_of(F.col("a")), syncmers.place_of(F.col("a"))).collect()} for i in (0, 1)}
    moved = {(h, p + 3) for h, p in held[0]}
    assert len(moved & held[1]) >= 0.8 * len(held[0]) > 10


def slow_counts(text):
    w = words_of(text)
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = set()
    for i, x in enumerate(win):
        if win.count(x) > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_rules(docs):
    df, rows = docs
    got = rules.judge(df).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    short = [r for r in rows if len(r[1] or "") < 9000]
    want = [(str(r[0]), *slow_counts(r[1])) for r in short]
    assert not {str(x) for x in want} - {str((str(r.doc_id), *(r[c] for c in names))) for r in got}
    assert len(got) == len(rows)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert rules.judge(df.where("false")).count() == 0


def slow_judge(rows):
    """The verdicts by sorting: buckets of all values of a source and weights of its language's, in order."""
    import math
    from collections import defaultdict

    bucket = lambda v: 0 if v < rules.LEAST else min(rules.BUCKETS, math.floor(math.log(max(v, rules.LEAST) / rules.LEAST) / math.log(rules.GROWTH) + 0.5) + 1)
    value = lambda k: 0.0 if k == 0 else rules.LEAST * rules.GROWTH ** (k - 1)
    lists = [len([x for x in (r[1] or "").split("\n") if words_of(x)]) for r in rows]
    held, groups = [], defaultdict(list)
    for r, lines in zip(rows, lists, strict=True):
        n, chars, symbols, dup, rep = slow_counts(r[1])
        v = {"symbols": symbols / max(n, 1), "repeated": rep / max(n, 1), "dup_lines": dup / max(lines, 1), "word_length": chars / max(n, 1), "n_words": max(n, 1), "n_lines": max(lines, 1)}
        held.append((v, n < 20 or 100 * rep > 30 * n))
        groups[r[2], r[3]].append(v | {"passed": not held[-1][1]})
    kept = []
    for r, (v, failed) in zip(rows, held, strict=True):
        if failed:
            kept.append((str(r[0]), False))
            continue
        own, lang = groups[r[2], r[3]], [x for k, g in groups.items() if k[0] == r[2] for x in g]

        def q(name, share, tail=False):
            seen = [(x, 1.0) for x in own] + [(x, min(1.0, rules.PRIOR / len(lang))) for x in lang]
            some = sorted((bucket(x[name]), w) for x, w in seen if not tail or x["passed"] and bucket(x[name]) > 0)
            total, upto = sum(w for _, w in some), 0.0
            for k, w in some:
                upto += w
                if upto >= share * total - 1e-9 * total:
                    return value(k)

        ok = True
        for s in rules.SIGNALS:
            find = s.unit / q(s.per, 0.5)
            high = q(s.name, 0.75) + rules.REACH * max(q(s.name, 0.75) - q(s.name, 0.5), find)
            if not s.low and (tail := q(s.name, rules.TAIL, tail=True)) is not None:
                high = min(high, tail * math.sqrt(rules.GROWTH))
            ok &= v[s.name] <= high
            ok &= not s.low or v[s.name] >= q(s.name, 0.25) - rules.REACH * max(q(s.name, 0.5) - q(s.name, 0.25), find)
        kept.append((str(r[0]), ok))
    return kept


def test_verdicts_by_sorting(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "c", None])
        n = rng.randrange(15, 60) if source == "b" else rng.randrange(15, 200)
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7 + 3 * (lang == "de")))) for _ in range(n)]
        if i % 15 == 0:
            words = [w + "###" for w in words]
        elif i % 15 == 1:
            words = [w * 6 for w in words]
        elif i % 15 == 2:
            words[3] += "#"  # a single find
        text = " ".join(words)
        rows.append((i // 2 if i < 6 else i, text if i % 40 else text + ("\n" + "q w") * 30, lang, source))  # some doc_ids and lines twice
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    want = slow_judge(rows)
    assert sorted((str(r.doc_id), r.kept) for r in rules.judge(df).collect()) == sorted(want)
    kept = {i for (_, ok), i in zip(want, range(400), strict=True) if ok}
    assert not any(i in kept for i in range(400) if i % 15 < 2) and sum(i in kept for i in range(2, 400, 15)) > 20
    limits = {(r.lang, r.source): r.high for r in rules.fences(rules.sketches(rules.signals(df))).where("signal = 'symbols'").collect()}
    assert len({round(limits["en", s], 4) for s in ("a", "b", "c")}) > 1  # a source has fences of its own


def test_sketches_merge(spark):
    df = spark.createDataFrame([(i, "word # " * (i % 7) + str(i) * (i % 5), "en", "ab"[i % 2]) for i in range(90)], "doc_id bigint, text string, lang string, source string")
    rows = rules.signals(df)
    whole = rules.sketches(rows)
    parts = rules.sketches(rows.where("doc_id % 3 = 0")).unionByName(rules.sketches(rows.where("doc_id % 3 > 0")))
    assert sorted(map(str, whole.collect())) == sorted(map(str, rules.merged(parts).select(*whole.columns).collect()))


def test_packing(docs):
    df, rows = docs
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(df, path, 256).collect()
    theirs = Tokenizer.from_file(path)
    want = []
    for r in rows:
        ids = [*theirs.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want += [(str(r[0]), k, at, len(ids[at : at + 256]), zlib.crc32(np.array(ids[at : at + 256], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 256))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert by.setdefault(r.sequence_id, 0) == r.offset
        by[r.sequence_id] += r.length
    # as good as best-fit over all pieces at once, but for a bin or two a task
    assert max(by.values()) <= 256 and len(by) <= len(packing.best_fit([r.length for r in got], 256)) + 3
    assert packing.pack(df.where("false"), path).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aAbé'stre 1\n\t.,!<|>"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=6))
def test_word_tokenizer_equals_the_library(texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    theirs = Tokenizer.from_file(path)
    got = [x.tolist() for x in packing.load(path).encode(texts)]
    assert got == [theirs.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_in_many_rounds(spark, monkeypatch):
    """Leftovers of many tasks climb the tree; every piece keeps a gapless place."""
    monkeypatch.setattr(packing, "FAN_IN", 2)
    rng = random.Random(8)
    df = spark.createDataFrame([(i, "a " * rng.randrange(1, 60)) for i in range(300)], "doc_id bigint, text string").repartition(13)
    got = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"), 64).collect()
    assert sorted(r.doc_id for r in got) == list(range(300))
    by = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert by.setdefault(r.sequence_id, 0) == r.offset
        by[r.sequence_id] += r.length
    # tasks of two dozen pieces commit early; tasks of thousands come within a bin or two
    assert max(by.values()) <= 64 and len(by) <= 1.1 * len(packing.best_fit([r.length for r in got], 64))


def test_another_tokenizer_is_refused(tmp_path):
    import json

    held = json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8"))
    held["normalizer"] = None
    (tmp_path / "t.json").write_text(json.dumps(held))
    with pytest.raises(ValueError):
        packing.WordTokenizer(str(tmp_path / "t.json"))


def test_best_fit():
    assert [sorted(b) for b in packing.best_fit([6, 5, 4, 5], 10)] == [[0, 2], [1, 3]]
    rng = random.Random(2)
    sizes = [rng.randrange(1, 100) for _ in range(500)]
    bins = packing.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(500)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)


def test_substring(docs):
    df, rows = docs
    got = substring.remove_repeats(df, carry=("lang",)).collect()
    big = lambda r: 1 << 62 if r[0] is None else r[0]
    first = {}
    for r in rows:
        w = words_of(r[1])
        for i in range(len(w) - 12):
            x = tuple(w[i : i + 13])
            first[x] = min(first.get(x, 1 << 63), big(r))
    want = []
    for r in rows:
        w = words_of(r[1])
        off = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < big(r):
                off[i : i + 13] = [True] * 13
        kept = " ".join(x for x, o in zip(w, off, strict=True) if not o)
        want.append((str(r[0]), len(w), sum(off), hashlib.sha256(kept.encode()).hexdigest(), (r[1] or "") if not any(off) else kept, str(r[2])))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256, r.text, str(r.lang)) for r in got) == sorted(want)
    assert substring.remove_repeats(df.where("false")).count() == 0


def test_cover_brings_any_two_places_together():
    inside = [p % substring.PERIOD in substring.COVER for p in range(100)]
    assert all(any(inside[i + d] and inside[j + d] for d in range(substring.PERIOD)) for i in range(40) for j in range(40))
    assert substring.PERIOD - 1 + substring.ANCHOR <= substring.WINDOW


def test_warc(spark):
    pages = [(3, "http://a b\n", "x", 1), (1, None, "x", 1), (2, "u", None, 1), (None, "u", "", 1), (1, "z", "x", 1), (5, "v", "<p>é\r\n\r\nWARC/1.1\r\n</p>\n", 1), (9, "w", "y" * 200_000, 1), (8, "w", "y" * 200_000, 1)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string, digest int")
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive(df.repartition(3)).collect())
    want = []
    for p, _, h, _ in pages:
        same_ = [q for q, _, g, _ in pages if (g or "") == (h or "") and q is not None]
        later = bool(same_) and p != min(same_)
        want.append((str(p), len((h or "").encode()), warc.base32_sha1((h or "").encode()), "revisit" if later else "response", min(same_) if later else None))
    assert got == sorted(want)
    assert warc.archive(df.where("false")).count() == 0


def test_arc_versions_and_damage():
    import io

    for v in (1, 2):
        text = warc.version_block(v) + warc.arc_record(v, "http://x/é y", "20010203", 4, "hé\n\nllo".encode()) + warc.arc_record(v, "http://z", "1", None, b"")
        found = list(warc.arc_records(io.BytesIO(text)))
        assert [b.partition(b"\r\n\r\n")[2].decode() for _, b in found] == ["hé\n\nllo", ""]
        assert found[0][0]["URL"] == "http://x/é%20y"
        with pytest.raises(ValueError):
            list(warc.arc_records(io.BytesIO(text[:-40])))
    assert warc.iso_date("20010203") == "2001-02-03T00:00:00Z" and warc.iso_date("bad") == "1970-01-01T00:00:00Z"


def test_bytes_that_are_no_text_survive(spark, tmp_path):
    """Latin-1 and binary bodies keep their bytes and digests, from ARC to WARC and back, a record a gzip member."""
    import gzip
    import io

    bodies = {1: "Käse".encode("latin-1"), 2: bytes(range(256)) * 40, 3: b"", 4: b"\0\0", 5: "Käse".encode("latin-1")}
    pages = spark.createDataFrame([(k, "http://u", bytearray(v)) for k, v in bodies.items()], "page_id bigint, url string, html binary").coalesce(1)
    warc.write_arc(pages, f"{tmp_path}/arc")
    read = {r.page_id: r for r in warc.read_arc(spark, f"{tmp_path}/arc").collect()}
    assert {k: bytes(r.payload) for k, r in read.items()} == bodies
    warc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    back = {r.page_id: r for r in warc.read_warc(spark, f"{tmp_path}/warc").collect()}
    assert {k: r.payload_digest for k, r in back.items()} == {k: warc.base32_sha1(v) for k, v in bodies.items()}
    assert back[5].record_type == "revisit" and back[5].refers_to_id == back[1].record_id
    raw = next(p.read_bytes() for p in (tmp_path / "warc").glob("part-*"))
    members, rest = 0, raw
    while rest:
        one = __import__("zlib").decompressobj(31)
        assert one.decompress(rest).startswith(b"WARC/1.1") and one.eof
        members, rest = members + 1, one.unused_data
    assert members == 6 and gzip.GzipFile(fileobj=io.BytesIO(raw)).read().count(b"WARC/1.1") == 6


def test_many_equal_pages_are_spread(spark):
    df = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("p"), F.col("id"))).alias("html"))
    got = warc.archive(df)
    assert got.where("record_type = 'revisit'").count() == 999 and got.where("refers_to = 0").count() == 999
    sizes = [r[1] for r in got.where("record_type = 'response'").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2] + 10


def test_long_records_are_several_members(monkeypatch):
    import gzip

    monkeypatch.setattr(warc, "MEMBER", 1000)
    record = random.Random(1).randbytes(4321)
    assert gzip.decompress(warc.member(record) + b"\0") == record


def test_classifier(spark, docs):
    df, rows = docs
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat"]) + rng.choice(["", "", ",", "."]) for _ in range(80))
    bad = lambda: " ".join(["WOW!!", "###", "BUY"][rng.randrange(3)] for _ in range(80))
    texts = [(i, good() if i % 3 else bad(), 0) for i in range(300)]
    corpus = spark.createDataFrame(texts, "doc_id bigint, text string, quality int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 300)] + [(None, 1, 0), (5, 7, 0)], "doc_id bigint, quality int, toxic int")
    got = classifier.classify(corpus, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == (r.doc_id % 3 > 0) for r in held) >= 0.97 * len(held) and all(r.predicted == (r.score >= 0.5) for r in got)
    assert len(classifier.classify(df, labels).collect()) == len(rows)
    none = classifier.classify(df, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert classifier.classify(df.where("false"), labels).count() == 0


def test_the_fit_is_a_plain_logistic_fit(monkeypatch):
    """Counts and n-grams together, against plain gradient descent on the same loss over whole matrices."""
    monkeypatch.setattr(classifier, "STEPS", 500)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=60) > 0).astype(int)
    better, worse = classifier.pairs_of(y)
    assert (y[better] == 1).all() and (y[worse] == 0).all()
    sparse = [classifier.shares(c) for c in classifier.grams([b"neither one" if i % 2 else b"good words here" if k else b"bad junk junk" for i, k in enumerate(y)])]
    cells, values = (np.concatenate(z) for z in zip(*sparse, strict=True))
    ends = np.r_[0, np.cumsum([len(c) for c, _ in sparse])]
    used = np.unique(cells)
    full = np.zeros((60, len(used)))
    for i, (c, v) in enumerate(sparse):
        full[i, np.searchsorted(used, c)] = v
    both = np.hstack([x, full])
    d, w = both[better] - both[worse], np.zeros(both.shape[1])
    penalty = np.r_[np.full(3, classifier.PENALTY), np.full(len(used), classifier.GRAM_PENALTY)]
    for _ in range(30_000):
        w -= 0.02 * (-(d / (1 + np.exp(d @ w))[:, None]).mean(0) + penalty * w)
    got = classifier.fit_weights(x, cells, values, ends, better, worse)
    assert np.allclose(got[:3], w[:3], atol=2e-3) and np.allclose(got[3 + used], w[3:], atol=2e-3)
    # cells that no text has weigh nothing; where n-grams tell nothing the counts decide
    assert np.count_nonzero(got) <= both.shape[1]
    said, told = full @ got[3 + used], np.arange(60) % 2 == 0
    assert said[told & (y == 1)].min() > said[told & (y == 0)].max()
    counted = x[~told] @ got[:3]
    assert ((counted > 0) == y[~told]).mean() > 0.7


def test_the_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(2)
    sparse = [classifier.shares(c) for c in classifier.grams([bytes(rng.choice(list(b"ab c"), 30)) for _ in range(8)])]
    cells, values = (np.concatenate(z) for z in zip(*sparse, strict=True))
    rest = (rng.normal(size=(8, 2)), cells, values, np.r_[0, np.cumsum([len(c) for c, _ in sparse])], np.array([0, 1, 2, 3]), np.array([4, 5, 6, 7]))
    w = rng.normal(size=2 + 2 * classifier.CELLS) * 0.1
    gradient = classifier.loss_of(w, *rest)[1]
    for at in (0, 1, 2 + int(cells[0]), 2 + int(cells[-1])):
        step = np.zeros(len(w))
        step[at] = 1e-5
        slope = (classifier.loss_of(w + step, *rest)[0] - classifier.loss_of(w - step, *rest)[0]) / 2e-5
        assert abs(slope - gradient[at]) < 1e-6


def test_grams_count_every_occurrence():
    words, chars = classifier.grams([b"a b a b", b"", b"abc"])[0]
    assert len(words) == 4 + 3 and len(chars) == 4 and words[0] == words[2] and words[4] == words[6]
    assert [len(x) for x in classifier.grams([b"x", b""])[1]] == [0, 0]
    cells, values = classifier.shares((words, chars))
    assert abs(values.sum() - 2 * classifier.SHARE) < 1e-3 and len(set(cells.tolist())) == len(cells)


def test_equal_texts_score_alike(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (3, None), (None, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2, 4)], "doc_id bigint, quality int")
    got = classifier.classify(df, labels).collect()
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1 and len({r.score for r in got if r.doc_id in (3, None)}) == 1


def test_repeated_words_of_random_sequences():
    rng = random.Random(4)
    for _ in range(200):
        w = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(0, 40))]
        assert textstats.repeated_words(w, 8) == slow_counts(b" ".join(w).decode())[4]


def test_pipeline_against_its_parts(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == list(corpus_pipeline.COLUMNS)
        after.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "quality_classifier":
            kept = {r.doc_id for r in docs.select("doc_id").collect()}
            truth = {r.doc_id: r.quality for r in labels.collect()}
            assert sum((d in kept) != bool(q) for d, q in truth.items()) <= 2
    left = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == left > 20
    assert corpus_pipeline.run(spark, sf).count() == packed.count()


def test_queries_are_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]
