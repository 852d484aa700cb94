"""Sweeps over a table by keyset pages that don't begin where nothing has changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "position bigint, done bigint, rows bigint, largest bigint, mark bigint, warm boolean, step bigint"


def fingerprint(rows: DataFrame, key: str = "id") -> tuple[int, int, int]:
    """(rows, largest key, xor of row hashes): alike whatever the order of rows or files."""
    r = rows.agg(F.count("*"), F.coalesce(F.max(key), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64(*rows.columns)), F.lit(0))).first()
    return int(r[0]), int(r[1]), int(r[2])


def state_of(spark: SparkSession, path: str) -> tuple:
    """The last state of the sweep at ``path``: (position, done, rows, largest, mark, warm, step)."""
    try:
        last = spark.read.schema(STATE).parquet(path).orderBy(F.desc("step")).first()
    except AnalysisException:
        last = None
    return tuple(last) if last else (0, 0, -1, -1, -1, False, 0)


def sweep(rows: DataFrame, path: str, work: Callable[[DataFrame], int], page: int, key: str = "id", marked: DataFrame | None = None) -> tuple[str, int]:
    """One step of a sweep: (status, rows read). ``work`` gets the next page by key and says how much it had to make.

    A sweep that has reached the end without making anything is warm, and stays idle -
    only the fingerprint of ``marked`` (the table itself, or what stands for it more
    cheaply) is read - until that changes. The state is a row for each step in the folder
    ``path``, so a sweep goes on after its driver was lost; a step may then be done again.
    """
    spark = rows.sparkSession
    position, done, n, largest, mark, warm, step = state_of(spark, path)
    now = fingerprint(rows if marked is None else marked, key)
    if warm and now == (n, largest, mark):
        return "idle", 0
    if position == 0:
        done = 0
    some = rows.where(F.col(key) > position).orderBy(key).limit(page)
    read, top = some.agg(F.count("*"), F.max(key)).first()
    made = int(work(some)) if read else 0
    done += made
    ended = read < page
    new = (0 if ended else top, 0 if ended else done, *((now) if ended else (n, largest, mark)), ended and done == 0, step + 1)
    spark.createDataFrame([new], STATE).coalesce(1).write.mode("append").parquet(path)
    return ("ended" if ended else "running"), read
