"""Where intermediate results stand: the folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; one is made only where driver and executors are one process."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="shoebox-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` as it is now, written to the shared folder: what follows starts from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def numbered(rows: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """Add the gapless place, from 0, of each row by ``order``.

    Rows are dealt into ranges, a task numbers its own, and the rows of earlier ranges are
    added; what meets in one task is a count for each range.
    """
    ranged = settled(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = counts.select("_part", F.expr("sum(_rows) over (order by _part) - _rows").alias("_before"))
    local = ranged.withColumn("_local", F.expr(f"row_number() over (partition by _part order by {', '.join(order)}) - 1"))
    return local.join(before, "_part").withColumn(name, (F.col("_before") + F.col("_local")).cast("bigint")).select(*rows.columns, name)


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are bounded by bytes (4 MB unless the session says otherwise), as rows that hold blocks of vectors need."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) in (None, str(2**31 - 1), "2147483647b"):
        conf.set(key, str(4 << 20))
    return df
