"""Document fingerprints from closed syncmers, in DataFrame code.

A k-mer is K consecutive tokens; it is a closed syncmer if the least hash among its inner
runs of S tokens is the first or the last of them. That depends on the k-mer alone, so equal
passages give equal anchors whatever stands around them, and whatever the texts' lengths.
Tokens are words; words too long to be words - as where no spaces are written - are taken
character by character. A fingerprint keeps the anchors of the whole text whose hash is in
the lowest part, one in RATE, and the LEAST anchors of least hash at any rate, with their
places; so it grows with the text, and at rate 1 it keeps all. Likeness is the share of
anchors in common (Dice), as far up the hashes as both fingerprints are complete, counting
only anchors whose places differ by about the same shift. At rate 1 it is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import cut

#: Tokens of a k-mer and of its inner runs; one anchor in RATE is kept, and LEAST at any rate; shifts in one stretch of SLACK tokens, or in two that touch, agree.
K, S, RATE, LEAST, SLACK = 3, 1, 4, 64, 16
#: Words of more characters than LONG are taken by characters.
LONG = 24
#: An anchor is one number: 32 bits of hash above 31 bits of position.
PLACE_BITS = 31


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _anchor(digest: Column, at: Column) -> Column:
    return F.shiftleft(digest.bitwiseAND(F.lit(0xFFFFFFFF)), PLACE_BITS).bitwiseOR(at.cast("bigint"))


def digest_of(anchor: Column) -> Column:
    return F.shiftright(anchor, PLACE_BITS)


def place_of(anchor: Column) -> Column:
    return anchor.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def tokens(text: Column) -> Column:
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    characters = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    parted = lambda ws: F.flatten(F.transform(ws, lambda w: F.when(F.length(w) > LONG, characters(w)).otherwise(F.array(w))))
    return let(words, lambda ws: F.when(F.exists(ws, lambda w: F.length(w) > LONG), parted(ws)).otherwise(ws))


def anchors(text: Column, rate: int = RATE, least: int = LEAST) -> Column:
    """The anchors of a text's fingerprint, ordered by hash; of equal anchors the first place.

    A text of fewer than K tokens, or without a syncmer, has one anchor: all its tokens. One without any has none.
    """

    def of_hashes(h: Column) -> Column:
        whole = F.array(_anchor(F.aggregate(h, F.lit(17).cast("bigint"), lambda a, x: F.xxhash64(a, x)), F.lit(0)))
        # runs of one token are the tokens
        def of_runs(r: Column) -> Column:
            last = K - S
            edge = lambda i: F.least(F.get(r, i), F.get(r, i + last)) <= F.array_min(F.slice(r, i + 2, F.lit(last - 1)))
            at = F.filter(F.sequence(F.lit(0), F.size(h) - K), edge)
            found = F.sort_array(F.transform(at, lambda i: _anchor(F.xxhash64(F.get(r, i), F.get(r, i + S), F.get(h, i + K - 1)), i)))
            distinct = let(found, lambda a: F.filter(a, lambda x, i: (i == 0) | (digest_of(x) != digest_of(F.get(a, i - 1)))))
            return distinct if rate == 1 else F.filter(distinct, lambda x, i: (i < least) | (digest_of(x) < (1 << 32) // rate))

        long = F.when(F.size(h) >= K, of_runs(h))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(
            let(F.coalesce(long, F.array().cast("array<bigint>")), lambda a: F.when(F.size(a) == 0, whole).otherwise(a))
        )

    return let(F.transform(tokens(text), lambda w: F.xxhash64(w)), of_hashes)


def shown(found: Column) -> Column:
    """A fingerprint as text: each anchor's hash in 8 hex digits and its place, in order of hash."""
    return F.concat_ws(" ", F.transform(found, lambda a: F.concat_ws("@", F.lpad(F.lower(F.hex(digest_of(a))), 8, "0"), place_of(a).cast("string"))))


def likeness(left: Column, right: Column, rate: int = RATE, least: int = LEAST) -> Column:
    """From 0 to 1: the share of anchors that two texts have in common, at places that agree.

    Two texts without anchors are alike; one with and one without are not.
    """

    def complete(a: Column) -> Column:
        """The largest hash up to which a fingerprint holds all anchors."""
        top = F.lit((1 << 32) - 1).cast("bigint")
        return top if rate == 1 else F.when(F.size(a) < least, top).otherwise(F.greatest(F.lit((1 << 32) // rate - 1).cast("bigint"), digest_of(F.get(a, F.size(a) - 1))))

    def agreed(x: Column) -> Column:
        common = lambda of: F.filter(of, lambda y: F.array_contains(x["shared"], digest_of(y)))
        shifts = F.sort_array(F.zip_with(common(x["a"]), common(x["b"]), lambda y, z: F.floor((place_of(y) - place_of(z)) / SLACK)))
        # the most anchors in one stretch of shifts and the next: the shifts come in order
        zero = F.struct(F.lit(None).cast("bigint").alias("last"), F.lit(0).alias("before"), F.lit(0).alias("run"), F.lit(0).alias("most"))

        def step(s: Column, k: Column) -> Column:
            before = F.when(s["last"] == k, s["before"]).when(s["last"] == k - 1, s["run"]).otherwise(0)
            run = F.when(s["last"] == k, s["run"] + 1).otherwise(1)
            return F.struct(k.alias("last"), before.alias("before"), run.alias("run"), F.greatest(s["most"], before + run).alias("most"))

        return 2.0 * F.aggregate(shifts, zero, step)["most"] / (F.size(x["a"]) + F.size(x["b"]))

    def cut_off(x: Column) -> Column:
        a, b = (F.filter(x[c], lambda y: digest_of(y) <= x["limit"]) for c in "ab")
        return let(F.struct(a.alias("a"), b.alias("b")), shared)

    def shared(x: Column) -> Column:
        both = F.array_intersect(F.transform(x["a"], digest_of), F.transform(x["b"], digest_of))
        return let(F.struct(x["a"].alias("a"), x["b"].alias("b"), both.alias("shared")), lambda y: F.when(F.size(y["shared"]) == 0, 0.0).otherwise(agreed(y)))

    both = F.struct(left.alias("a"), right.alias("b"), F.least(complete(left), complete(right)).alias("limit"))
    return F.when((F.size(left) == 0) & (F.size(right) == 0), 1.0).otherwise(let(both, cut_off))


def following(docs: DataFrame) -> DataFrame:
    """(key, next_key) for each distinct key, in descending order; the last is followed by the first.

    Keys are range-partitioned; each task looks one key ahead among its own, and the first
    key of the next task that has any is joined on from one row per task.
    """
    ids = docs.select("key").distinct()
    ranged = cut(ids.repartitionByRange(F.desc("key")).withColumn("_part", F.spark_partition_id()), "ids")
    ends = ranged.groupBy("_part").agg(F.max("key").alias("_first"), F.min("key").alias("_last"))
    then = F.coalesce(F.expr("lead(_first) over (order by _part)"), F.expr("max(_first) over ()"))
    ends = ends.select(F.col("_last"), then.alias("_then"))
    local = ranged.withColumn("_next", F.expr("lead(key) over (partition by _part order by key desc)"))
    return local.join(ends, local["key"] == ends["_last"], "left").select("key", F.coalesce("_next", "_then").alias("next_key"))


def compare(docs: DataFrame, rate: int = RATE, least: int = LEAST) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text is empty. The edited text has the last floor(n_chars / 2) code points
    replaced by the first as many, or all, of the next document's. The next document is
    that of the next smaller doc_id, after the least the largest; a null doc_id counts as
    the least of all. Where several rows share that doc_id, the one of least (length, hash)
    stands for it. The only id of a table is followed by itself. Repeated rows stay; very
    long texts are fingerprinted whole; other columns are ignored; an empty table gives an
    empty result.
    """
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    marks = lambda text: anchors(text, rate, least)
    own = docs.select(F.col("doc_id").cast("bigint").alias("_doc"), key.alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sizes = cut(own.select("key", F.length("text").alias("n_chars")).groupBy("key").agg(F.max("n_chars").alias("most")), "sizes")
    wants = sizes.join(following(sizes), "key").select(F.col("key").alias("_of"), F.col("next_key").alias("_from"), (F.col("most") / 2).cast("int").alias("_half"))
    # both joins deal the same columns out by the same key, so one exchange serves both; what a document
    # needs of the one after it, half as many characters as it has and the anchors, goes to it by key
    after = wants.join(own, wants["_from"] == own["key"]).select(
        "_of", F.struct(F.length("text").alias("n"), F.xxhash64("text").alias("h"), F.col("_doc").alias("d")).alias("_place"), F.expr("left(text, _half)").alias("_text"), marks(F.col("text")).alias("_anchors")
    )
    given = after.groupBy("_of").agg(F.min_by(F.struct("_text", "_anchors"), "_place").alias("_next"))
    both = own.join(given, own["key"] == given["_of"], "left")
    edited = F.expr("concat(left(text, length(text) - cast(length(text) div 2 as int)), left(coalesce(_next._text, text), cast(length(text) div 2 as int)))")
    both = both.select("_doc", F.length("text").cast("bigint").alias("n_chars"), marks(F.col("text")).alias("anchors"), edited.alias("_edited"), F.col("_next._anchors").alias("_next"))
    both = both.select("_doc", "n_chars", "anchors", "_next", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), marks(F.col("_edited")).alias("edited"))
    return both.select(
        F.col("_doc").alias("doc_id"), "n_chars", "edited_sha256",
        shown(F.col("anchors")).alias("fingerprint"), shown(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited"), rate, least).alias("near_edited"), likeness(F.col("anchors"), F.coalesce("_next", "anchors"), rate, least).alias("near_next"),
    )
