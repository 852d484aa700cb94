"""Importance resampling: documents are drawn so that they resemble a target collection.

Features are runs of words, hashed into buckets. A bucket's gain is the logarithm of how
much more often the target has it; a document weighs the mean gain of its features, and
the highest weights with Gumbel noise added are drawn, which is drawing without
replacement in proportion to the weights' exponentials.

Equal texts weigh the same, so rows are first collapsed by their whole text: a text is
split and hashed once, counts for as many rows as have it, and its weight is joined back
to those rows by the text's digest before each row gets noise of its own. All of it is
DataFrame code; what reaches every task is one row for each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import cut, forget
from shoebox.llm.license import LOWER, SEPARATORS, UPPER, words_of
from shoebox.llm.sharding import crc32_sql, places

BUCKETS = 10_000
SEED = 2024
#: Of the documents with at least LEAST_WORDS words so many in a hundred are drawn.
PERCENT, LEAST_WORDS = 10, 20


def features(words: Column, longest: int = 1) -> Column:
    """All runs of 1 to ``longest`` consecutive words, joined by one space."""
    if longest == 1:
        return words

    def runs(k: int) -> Column:
        begins = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(begins, lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))

    return F.concat(words, *(runs(k) for k in range(2, longest + 1)))


def bucketed(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """``texts`` with n_words and the bucket of each feature instead of text."""
    split = texts.withColumn("words", words_of(F.col("text"))).drop("text")
    hashed = F.transform(features(F.col("words"), longest), lambda f: (F.crc32(f.cast("binary")) % buckets).cast("int"))
    return split.select(*(c for c in split.columns if c != "words"), F.size("words").cast("bigint").alias("n_words"), hashed.alias("buckets"))


def _counts(held: DataFrame, name: str) -> DataFrame:
    return held.select("copies", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum("copies").alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket, from tables of (copies, buckets)."""
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = cut(every.join(_counts(source, "s"), "bucket", "left").join(_counts(target, "t"), "bucket", "left").fillna(0), "bucket_counts")
    total = both.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    up = (F.col("t") + 1).cast("double") * float(total[0] + buckets)
    down = (F.col("s") + 1).cast("double") * float(total[1] + buckets)
    return both.select("bucket", F.floor(1000 * F.log(up / down)).alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, which the doc_id and the seed decide; a missing doc_id counts as the text 'null'."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; rank 1, 2, 3... of the drawn rows, else null.

    Of N rows with ``least_words`` words or more, floor(percent * N / 100) of highest score
    are drawn, ties to the smaller doc_id; a missing doc_id comes after all others. Null
    and blank texts have no features and weight 0. Repeated rows are rows of their own
    that count each and share their noise, as do all rows of one doc_id. An empty table
    gives an empty result, an empty target is a target without features; very long texts
    are counted whole; other columns are ignored. ``buckets`` rows are broadcast and as many
    scores as there are whole numbers between the least and the largest are counted on
    the driver: logarithms bound both ends to some tens of thousands.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("key"))
    whole = docs.select(text.alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    held = cut(bucketed(whole.select(F.unhex(F.sha2("text", 256)).alias("key"), "copies", "text"), longest, buckets), "texts")
    aim = cut(bucketed(target.select(F.lit(1).cast("bigint").alias("copies"), text.alias("text")), longest, buckets), "target")

    gain = F.broadcast(gains(held, aim, buckets))  # ``buckets`` rows, whatever the corpus
    each = held.select("key", F.explode("buckets").alias("bucket")).join(gain, "bucket").groupBy("key").agg(F.sum("gain").alias("total"), F.count("*").alias("n_features"))
    mean = F.expr("(total - pmod(total, n_features)) div n_features")
    # a written table: the join below may then part a text of very many copies over several tasks
    weights = cut(held.select("key", "n_words").join(each, "key", "left").select("key", "n_words", F.coalesce("n_features", F.lit(0)).alias("n_features"), F.coalesce(mean, F.lit(0)).alias("weight")), "weights")
    forget(held, aim)

    scored = cut(rows.join(weights, "key").select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score")), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    found = sorted(((r["score"], r["count"]) for r in able.groupBy("score").count().collect()), reverse=True)
    drawn, border, before = percent * sum(n for _, n in found) // 100, None, 0
    for score, n in found:
        if before < drawn:
            border, before = score, before + n
    columns = ("doc_id", "n_features", "weight", "score")
    if border is None:
        return scored.select(*columns, F.lit(None).cast("bigint").alias("rank"))
    in_reach = (F.col("n_words") >= least_words) & (F.col("score") >= border)
    near = scored.where(in_reach).withColumns({"_all": F.lit(0), "_down": -F.col("score"), "_none": F.col("doc_id").isNull()})
    ranked = places(near, "_all", ["_down", "_none", "doc_id"])
    rank = F.when(F.col("slot") < drawn, F.col("slot") + 1).cast("bigint")
    return ranked.select(*columns, rank.alias("rank")).unionByName(scored.where(~in_reach).select(*columns, F.lit(None).cast("bigint").alias("rank")))


def oracle(buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> str:
    """The same rows in DuckDB SQL, for features of one word; each distinct word is hashed once."""
    table, crc = crc32_sql()
    words = f"unnest(list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}'), lambda x: x <> ''))"
    return f"""
    WITH numbered AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
    said AS (SELECT rid, {words} AS t FROM numbered), aimed AS (SELECT {words} AS t FROM benchmark),
    vocabulary AS (SELECT DISTINCT t FROM (SELECT t FROM said UNION ALL SELECT t FROM aimed)),
    hashed AS (SELECT t, ({crc}) % {buckets} AS bucket FROM vocabulary, {table}),
    s AS (SELECT bucket, count(*) AS s FROM said JOIN hashed USING (t) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM aimed JOIN hashed USING (t) GROUP BY bucket),
    total AS (SELECT (SELECT count(*) FROM said) AS all_s, (SELECT count(*) FROM aimed) AS all_t),
    gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + {buckets})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + {buckets})::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket), total),
    summed AS (SELECT rid, count(*) AS n, sum(gain)::BIGINT AS g FROM said JOIN hashed USING (t) JOIN gain USING (bucket) GROUP BY rid),
    weighed AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0) AS weight,
      ('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT::DOUBLE AS h FROM numbered LEFT JOIN summed USING (rid)),
    scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0)))::BIGINT AS score FROM weighed),
    ranked AS (SELECT *, CASE WHEN n_features >= {least_words} THEN row_number() OVER (PARTITION BY n_features >= {least_words} ORDER BY score DESC, doc_id NULLS LAST) END AS place, count(*) FILTER (n_features >= {least_words}) OVER () AS able FROM scored)
    SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN place <= {percent} * able // 100 THEN place END::BIGINT AS rank FROM ranked"""
