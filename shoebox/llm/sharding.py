"""Sharding by weighted rendezvous hashing, with gapless places inside each shard.

Every shard draws a number for every key; the shard whose weighted draw is largest holds
the key. A further shard only adds draws, so it takes keys into itself and moves no other.
All of it is DataFrame code: draws are columns, places come from a range partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import cut

#: Hex digits of a draw: 52 bits, which a double holds exactly.
DIGITS = 13


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) that the key and the shard decide."""
    digest = F.md5(F.concat(key, F.lit(f":{shard}")))
    whole = F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double")
    return (whole + 0.5) / float(16**DIGITS)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, that holds ``key``. A null key counts as the text 'null'.

    A shard of weight w wins a share of keys in proportion to w. Equal weights compare
    the draws themselves, which orders shards as the logarithms would.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    key = F.coalesce(key.cast("string"), F.lit("null"))
    even = len(set(weights)) == 1
    scores = [draw(key, i) if even else -F.lit(float(w)) / F.log(draw(key, i)) for i, w in enumerate(weights)]
    best = F.array_max(F.array(*(F.struct(s.alias("score"), F.lit(i).alias("shard")) for i, s in enumerate(scores))))
    return best["shard"]


def grown(key: Column, held: Column, weights: Sequence[float], extra: float) -> Column:
    """The shard once a shard of weight ``extra`` is added to those of ``weights``."""
    return F.when(rendezvous(key, [*weights, extra]) == len(weights), F.lit(len(weights))).otherwise(held)


def places(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Add ``slot``: the gapless place, from 0, of each row in its group by ``order``.

    Rows are range-partitioned by group, order and a tie-breaker, so that neither a large
    group nor a repeated key lands in one task; a task numbers its own rows, and the rows
    that earlier tasks hold of a group are added to them. What is counted is one row per
    task and group.
    """
    numbered = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [group, *order, "_tie"]
    ranged = cut(numbered.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "places")
    counts = ranged.groupBy(group, "_part").agg(F.count("*").alias("_rows"))
    before = counts.select(
        F.col(group).alias("_group"), F.col("_part").alias("_p"),
        F.expr(f"sum(_rows) over (partition by {group} order by _part) - _rows").alias("_before"),
    )
    local = ranged.withColumn("_local", F.expr(f"row_number() over (partition by _part, {group} order by {', '.join(keys[1:])}) - 1"))
    joined = local.join(before, (local[group] == before["_group"]) & (local["_part"] == before["_p"]))
    return joined.withColumn("slot", F.col("_local") + F.col("_before")).drop("_tie", "_part", "_p", "_group", "_local", "_before")


def shard_rows(docs: DataFrame, weights: Sequence[float], extra: float = 1.0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    size is the text's UTF-8 bytes and 8 more, a null text has none; its text_crc32 is
    that of no bytes. Law ``key``: doc_id and the weights decide the shard, so repeated
    rows meet in one shard, at places of their own, and rows without a doc_id share a
    shard. slot counts a shard's rows by doc_id (null first), text_crc32 and size.
    An empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("bigint")
    narrow = docs.select(
        doc_id.alias("doc_id"), (F.octet_length(text).cast("bigint") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        rendezvous(doc_id, weights).alias("shard"),
    )
    narrow = cut(narrow.withColumn("grown_shard", grown(F.col("doc_id"), F.col("shard"), weights, extra)), "shards")
    return places(narrow, "shard", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), "grown_shard"
    )


def oracle(n_shards: int) -> str:
    """The same rows in DuckDB SQL, for equal weights."""
    value = lambda i: f"(('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':{i}'), 1, {DIGITS}))::BIGINT::DOUBLE + 0.5) / {16**DIGITS}.0"
    draws = ", ".join(value(i) for i in range(n_shards + 1))
    table, crc = crc32_sql()
    return f"""
    WITH drawn AS (SELECT doc_id, coalesce(text, '') AS t, [{draws}] AS d FROM documents),
    held AS (SELECT doc_id, t, list_position(d[1:{n_shards}], list_max(d[1:{n_shards}])) - 1 AS shard, list_position(d, list_max(d)) - 1 AS grown_shard FROM drawn),
    sized AS (SELECT doc_id, strlen(t) + 8 AS size, {crc} AS text_crc32, shard, grown_shard FROM held, {table})
    SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
      row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard::INTEGER AS grown_shard
    FROM sized"""


def crc32_sql() -> tuple[str, str]:
    """A one-row table of the reflected polynomial, and over it the CRC-32 of the UTF-8 bytes of t: a fold over the list of bytes."""
    over = "[('0x' || substr(hex(encode(t)), 2 * i::INTEGER + 1, 2))::BIGINT for i in range(strlen(t))]"
    return _TABLE_SQL, f"xor(list_reduce(list_prepend(4294967295::BIGINT, {over}), lambda acc, b: xor(acc >> 8, crc_table[xor(acc, b) % 256 + 1])), 4294967295)"


_TABLE_SQL = """(SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS crc_table FROM range(256) AS r(b))"""
