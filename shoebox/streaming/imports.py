"""The import as a stream: batches of files become deltas beside a ledger, and a replay writes nothing twice.

A batch's delta is written to a folder of its own number, which a replay overwrites, and
counts once the ledger has its row. The ledger's row also has the ranges of ids that the
batch gave out; a batch that it has is passed over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.library import Library
from shoebox.operators.imports import KEYS, apply_delta, import_delta, latest

LEDGER = "batch bigint, first_image bigint, last_image bigint, first_face bigint, last_face bigint"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(batch, first_image, last_image, first_face, last_face) of the batches that count; a range is null where a batch gave out no id."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{path}/ledger")
    except AnalysisException:
        return spark.createDataFrame([], LEDGER)


def library_now(base: Library, path: str) -> Library:
    """The library that a stream has begun with, and all that its batches changed."""
    spark = base.face.sparkSession
    # only folders that count are listed: others may be written over at any time
    done = [r.batch for r in ledger(spark, path).select("batch").collect()]
    if not done:
        return base
    read = lambda name: spark.read.option("basePath", f"{path}/delta/{name}").parquet(*(f"{path}/delta/{name}/batch={b}" for b in done))
    return apply_delta(base, {name: latest(read(name), key) for name, key in KEYS.items()})


def import_sink(base: Library, path: str, detect: Callable[[DataFrame], DataFrame], clock=F.current_timestamp) -> Callable[[DataFrame, int], None]:
    """A sink of ``foreachBatch``: imports a batch of hashed files into the library at ``path``, once for each batch number.

    ``detect`` gives the faces of files as ``import_delta`` takes them.
    """

    def sink(files: DataFrame, batch: int) -> None:
        spark = files.sparkSession
        if ledger(spark, path).where(F.col("batch") == batch).limit(1).count():
            return
        lib = library_now(base, path)
        for name, rows in import_delta(lib, files, detect(files), clock()).items():
            rows.write.mode("overwrite").parquet(f"{path}/delta/{name}/batch={batch}")
        read = lambda name: spark.read.parquet(f"{path}/delta/{name}/batch={batch}").where("not gone").select("id")
        images = read("image").join(lib.image.select("id"), "id", "left_anti").agg(F.min("id"), F.max("id")).first()
        faces = read("face").agg(F.min("id"), F.max("id")).first()
        spark.createDataFrame([(batch, *images, *faces)], LEDGER).coalesce(1).write.mode("append").parquet(f"{path}/ledger")

    return sink


def run_import(files: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a stream of hashed files into a sink, over all that is there now."""
    return files.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
