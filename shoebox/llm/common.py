"""Helpers that the operators share: scratch tables and whole-text access."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch, where the session sets no limit: a batch of long texts must fit a small worker.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share. Only where driver and executors are one process may it be a local one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="shoebox-"))
    return sc.getCheckpointDir()


def in_small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, in a session whose Arrow batches are bounded by bytes: BATCH_BYTES unless the session says otherwise."""
    conf = docs.sparkSession.conf
    if conf.get(_BATCH, None) in (None, str(2**31 - 1), "2147483647b"):
        conf.set(_BATCH, str(BATCH_BYTES))
    return docs


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: what follows starts from there.

    The shuffle files of the write go with its end, as nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    held = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if held is None else spark.conf.set(_CLEANUP, held)
    held = spark.read.schema(df.schema).parquet(path)
    held.scratch_path = path
    return held


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once nothing reads them any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def byte_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def pieces(n_rows: int, step: int):
    return (slice(i, min(i + step, n_rows)) for i in range(0, n_rows, step))


def slices(column: pa.Array, most_bytes: int = 6 << 20):
    """Slices of a text column of about so many bytes each, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    part = np.cumsum(sizes) // most_bytes
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    return [slice(int(a), int(b)) for a, b in zip(edges, np.r_[edges[1:], len(sizes)], strict=True)]


_SPACES = bytes.maketrans(b"\t\n\r\x0b\x0c", b"     ")


def coded_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, codes, offsets): each text parted at spaces, a word as its place among the distinct ones."""
    lists = pc.split_pattern(texts, " ")
    words = lists.flatten().dictionary_encode()
    offsets = np.r_[0, np.cumsum(np.asarray(pc.list_value_length(lists), np.int64))] if len(texts) else np.zeros(1, np.int64)
    return words.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(words.indices, np.int64), offsets


def spaced_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, codes, offsets) of texts parted at ASCII white space; the words of text i are codes[offsets[i] : offsets[i + 1]]."""
    words, codes, offsets = coded_words(pa.array([t.translate(_SPACES) for t in texts], pa.binary()))
    if b"" in words:
        there = codes != words.index(b"")
        before = np.r_[0, np.cumsum(there)]
        codes, offsets = codes[there], before[offsets]
    return words, codes, offsets


def digests(words: list[bytes]) -> np.ndarray:
    """A 128-bit hash of each word, as rows of two uint64."""
    raw = b"".join(map(xxhash.xxh3_128_digest, words))
    return np.frombuffer(raw, np.uint64).reshape(-1, 2)


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs flat[starts[i] : starts[i] + sizes[i]] one after another."""
    before = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]
