"""Quality rules with thresholds that follow the data, per language and source.

Signals of every text are counted into quantile sketches: a value falls into one of at most
BUCKETS + 1 buckets, whose bounds grow by a constant factor, and a sketch is the number of
texts by bucket. So a sketch is bounded, a quantile read from it is off by half that factor
at most, and sketches of parts, days or sources merge by addition and give the same
thresholds in whatever order they meet. A source's fence for a signal is made of quantiles
of its own sketch, into which its language's is mixed with the weight of PRIOR texts, so a
small source leans on its language and a large one on itself. Of what most texts have none
of, a fence also stands no farther out than the tail of those that have some and that the
base rule passes. Texts beyond a fence go.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.llm import textstats as ts
from shoebox.llm.common import byte_texts, cut, in_small_batches

#: The contract's base rule.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8


@dataclass(frozen=True)
class Signal:
    """A signal: what is counted, by what it is divided, and the least that a single find adds to the count."""

    name: str
    count: str
    per: str
    unit: int
    low: bool = False


#: What is measured, each a value per word or per line; only ``word_length`` has a fence below too.
SIGNALS = (
    Signal("symbols", "n_symbols", "n_words", 1),
    Signal("repeated", "n_repeat_words", "n_words", 2 * WINDOW),
    Signal("dup_lines", "n_dup_lines", "n_lines", 1),
    Signal("word_length", "word_chars", "n_words", 0, low=True),
)
#: Sizes of texts; their medians tell how much a single find weighs in a source.
SIZES = ("n_words", "n_lines")
#: The factor between the bounds of buckets, the least value with a bucket of its own, and the number of buckets above 0.
GROWTH, LEAST, BUCKETS = 1.02, 1e-4, 1200
#: A fence stands REACH times the distance from the median to the quartile away from the quartile; PRIOR texts of the language are mixed in.
REACH, PRIOR = 8.0, 100.0
#: Of the texts that have any of what a signal counts, the share that its fence leaves in at least.
TAIL = 0.99
COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint"


def counts_of(text: bytes) -> tuple[int, ...]:
    words = text.split()
    chars = ts.code_points(text) - ts.count_of(text, ts.WHITE)
    lines = sum(1 for x in text.split(b"\n") if x.strip(ts.WHITE))
    return len(words), chars, ts.count_of(text, ts.SYMBOLS), ts.duplicate_lines(text), ts.repeated_words(words, WINDOW), lines


def signals(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``docs`` with its counts and without its text: doc_id, lang, source, the columns of COUNTS, and those of ``keep`` with a line before their names."""
    names = [c.split()[0] for c in COUNTS.split(", ")]

    def run(batches):
        for b in batches:
            found = np.array([counts_of(t) for t in byte_texts(b)], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "lang", "source")), *(pa.array(found[:, i]) for i in range(len(names))), *(b.column(c) for c in kept)], ["doc_id", "lang", "source", *names, *kept])

    kept = [f"_{c}" for c in keep]
    narrow = in_small_batches(docs).select(F.col("doc_id").cast("bigint"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"), *(F.col(c).alias(f"_{c}") for c in keep))
    more = "".join(f", {c} {narrow.schema[c].dataType.simpleString()}" for c in kept)
    return narrow.mapInArrow(run, f"doc_id bigint, lang string, source string, {COUNTS}{more}")


def values(rows: DataFrame) -> dict[str, Column]:
    """What the sketches count of a row: the signals, and the sizes."""
    found = {s.name: F.col(s.count) / F.greatest(F.col(s.per), F.lit(1)) for s in SIGNALS}
    return found | {c: F.greatest(F.col(c), F.lit(1)).cast("double") for c in SIZES}


def base_failed() -> Column:
    """What the base rule says of a row's counts."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def bucket(value: Column) -> Column:
    """The bucket of a value: 0 below LEAST, else by the logarithm, BUCKETS at most."""
    place = F.round(F.log(F.greatest(value, F.lit(LEAST)) / LEAST) / math.log(GROWTH)).cast("int") + 1
    return F.when(value < LEAST, 0).otherwise(F.least(place, F.lit(BUCKETS)))


def value_of(bucket_: Column) -> Column:
    return F.when(bucket_ == 0, 0.0).otherwise(LEAST * F.pow(F.lit(GROWTH), bucket_ - 1))


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, signal, bucket, texts, passed): the sketch of every signal and source; of the texts, those that the base rule passes."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("signal"), bucket(v).alias("bucket")) for name, v in values(rows).items())))
    counted = rows.select("lang", "source", each.alias("x"), (~base_failed()).cast("bigint").alias("passed"))
    return counted.groupBy("lang", "source", "x.signal", "x.bucket").agg(F.count("*").alias("texts"), F.sum("passed").alias("passed"))


def merged(parts: DataFrame) -> DataFrame:
    """One sketch from several of the same source: buckets add up."""
    return parts.groupBy("lang", "source", "signal", "bucket").agg(F.sum("texts").alias("texts"), F.sum("passed").alias("passed"))


def _quantile(held: Column, total: Column, q: float, weight: str = "w") -> Column:
    """The value at share q of a sketch given as its buckets in order, array<struct<bucket, w, ok>>; ``weight`` is w (all texts) or ok (those that passed)."""
    start = F.struct(F.lit(0.0).alias("upto"), F.lit(None).cast("int").alias("at"))
    # the least bucket with the share at or below it; a hair's breadth for sums of weights
    step = lambda a, x: F.struct((a["upto"] + x[weight]).alias("upto"), F.when(a["at"].isNotNull(), a["at"]).when(a["upto"] + x[weight] >= q * total - 1e-9 * total, x["bucket"]).alias("at"))
    return value_of(F.aggregate(held, start, step)["at"])


def fences(sketch: DataFrame) -> DataFrame:
    """(lang, source, signal, low, high, middle): the values beyond which a text goes, and the median. Null languages and sources are groups like others.

    The distance from the median to the quartile counts as no less than what a single find
    adds in a text of the source's median size; so where three of four texts have none of
    what a signal counts, the fence is as many finds as REACH, or the value at share TAIL of
    the texts that have some and passed the base rule (the upper bound of its bucket) where
    that is less. At most one in a hundred of those goes by the second, and none where they
    weigh less than a hundred texts.
    """
    wide = sketch.groupBy("lang", "signal", "bucket").agg(F.sum("texts").alias("n"), F.sum("passed").alias("ok"))
    # a language's sketch is one short array: a bucket each
    lang = wide.groupBy("lang", "signal").agg(F.collect_list(F.struct("bucket", "n", "ok")).alias("all"), F.sum("n").alias("most"))
    lang = lang.select(F.col("lang").alias("_lang"), F.col("signal").alias("_signal"), F.transform("all", lambda x: F.struct(x["bucket"].alias("bucket"), *((x[c] * F.least(F.lit(1.0), PRIOR / F.col("most"))).alias(w) for c, w in (("n", "w"), ("ok", "ok"))))).alias("prior"))
    own = sketch.groupBy("lang", "source", "signal").agg(F.collect_list(F.struct("bucket", F.col("texts").cast("double").alias("w"), F.col("passed").cast("double").alias("ok"))).alias("own"))
    both = own.join(lang, own["lang"].eqNullSafe(lang["_lang"]) & (own["signal"] == lang["_signal"]))
    held = both.select("lang", "source", "signal", F.array_sort(F.concat("own", "prior")).alias("held"))
    held = held.withColumn("total", F.aggregate("held", F.lit(0.0), lambda a, x: a + x["w"]))
    held = held.withColumn("some", F.filter("held", lambda x: (x["bucket"] > 0) & (x["ok"] > 0))).withColumn("holders", F.aggregate("some", F.lit(0.0), lambda a, x: a + x["ok"]))
    q = held.select(
        "lang", "source", "signal", *(_quantile(F.col("held"), F.col("total"), x).alias(name) for name, x in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))),
        (_quantile(F.col("some"), F.col("holders"), TAIL, "ok") * math.sqrt(GROWTH)).alias("tail"),
    )
    size = q.where(F.col("signal").isin(*SIZES)).groupBy("lang", "source").agg(*(F.max(F.when(F.col("signal") == c, F.col("q2"))).alias(c) for c in SIZES))
    size = size.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    q = q.where(~F.col("signal").isin(*SIZES))
    q = q.join(size, q["lang"].eqNullSafe(size["_lang"]) & q["source"].eqNullSafe(size["_source"]))
    find = F.coalesce(*(F.when(F.col("signal") == s.name, s.unit / F.col(s.per)) for s in SIGNALS))
    low_too = F.col("signal").isin([s.name for s in SIGNALS if s.low])
    high = F.col("q3") + REACH * F.greatest(F.col("q3") - F.col("q2"), find)
    # every text has words of some length, so that has no tail of holders
    high = F.when(low_too, high).otherwise(F.least(high, F.col("tail")))
    low = F.when(low_too, F.col("q1") - REACH * F.greatest(F.col("q2") - F.col("q1"), find))
    return q.select("lang", "source", "signal", low.alias("low"), high.alias("high"), F.col("q2").alias("middle"))


def judge(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the columns ``keep``.

    A text goes if the base rule fails it (fewer than LEAST_WORDS words, or over
    MOST_REPEATED percent of them repeated) or a signal lies beyond its source's fence; a
    value at a fence stays. A null text has no words; rows without a language or source form
    groups of their own; repeated rows stay, and count again in the sketches; very long
    texts are counted whole; other columns are ignored; an empty table gives an empty result.
    The fences are one row for each source, so their join is left to the optimizer's size check.
    """
    rows = cut(signals(docs, keep), "signals")
    limits = cut(fences(sketches(rows)), "fences")
    wide = limits.groupBy("lang", "source").agg(
        *(F.max(F.when(F.col("signal") == s.name, F.col("high"))).alias(f"high_{s.name}") for s in SIGNALS),
        *(F.max(F.when(F.col("signal") == s.name, F.col("low"))).alias(f"low_{s.name}") for s in SIGNALS if s.low),
    ).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    beyond, value = F.lit(False), values(rows)
    for s in SIGNALS:
        beyond = beyond | (value[s.name] > F.col(f"high_{s.name}"))
        if s.low:
            beyond = beyond | (value[s.name] < F.col(f"low_{s.name}"))
    failed = base_failed()
    joined = rows.join(wide, rows["lang"].eqNullSafe(wide["_lang"]) & rows["source"].eqNullSafe(wide["_source"]), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & ~F.coalesce(beyond, F.lit(False))).alias("kept"), *(F.col(f"_{c}").alias(c) for c in keep),
    )
