"""Files as a source: scans with content hashes, decoding, detection, and text inventories."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of the images that are taken in.
SUFFIXES = (".jpg", ".jpeg", ".png")
FACE = "image_id bigint, bbox_x double, bbox_y double, bbox_w double, bbox_h double, embedding array<float>, error string"


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, directory, filename, file_size, modified_at_ns, created_at) of the images below a folder; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    lower = F.lower("path")
    hit = lower.endswith(SUFFIXES[0])
    for s in SUFFIXES[1:]:
        hit = hit | lower.endswith(s)
    path = F.regexp_replace("path", "^file:/+", "/")
    return found.where(hit).select(
        path.alias("path"), F.regexp_replace(path, "/[^/]*$", "").alias("directory"), F.element_at(F.split(path, "/"), -1).alias("filename"),
        F.col("length").alias("file_size"), (F.unix_micros("modificationTime") * 1000).alias("modified_at_ns"), F.col("modificationTime").alias("created_at"),
    )


def hash_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content_hash, content) of the images below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    hit = F.lower("path").rlike(r"\.(jpg|jpeg|png)$")
    return found.where(hit).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.sha2("content", 256).alias("content_hash"), "content")


def detect_faces(images: DataFrame, detector: Callable[[bytes], list[dict]]) -> DataFrame:
    """One row for each face that ``detector`` finds in (image_id, content): its box and vector. An unreadable image gives one row with an error.

    The detector is the caller's: a function of the file's bytes that returns dicts with
    bbox (x, y, w, h) and embedding; vectors are scaled to unit length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            rows = []
            for image_id, content in zip(b["image_id"], b["content"], strict=True):
                try:
                    for f in detector(bytes(content)):
                        v = np.asarray(f["embedding"], np.float32)
                        rows.append((image_id, *map(float, f["bbox"]), (v / max(float(np.linalg.norm(v)), 1e-12)).tolist(), None))
                except Exception as e:  # noqa: BLE001 - one bad file must not end the scan
                    rows.append((image_id, None, None, None, None, None, str(e)[:500]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FACE.split(", ")])

    return images.select("image_id", "content").mapInPandas(run, FACE)


def parse_changelog(lines: DataFrame) -> DataFrame:
    """(version, date, section, item) from (n, value): Markdown of releases, sections and items; a release's title is carried down to its items."""
    version = F.regexp_extract("value", r"^## \[?([^\]\s]+)\]?", 1)
    date = F.regexp_extract("value", r"^## .*?(\d{4}-\d{2}-\d{2})", 1)
    section = F.regexp_extract("value", r"^### (.+?)\s*$", 1)
    marked = lines.select("n", "value", F.when(version != "", F.struct(version.alias("v"), date.alias("d"))).alias("release"), F.when(section != "", section).alias("section"))
    # one document's lines: a changelog is one file, so its order is one window
    over = "over (order by n rows between unbounded preceding and current row)"
    carried = marked.withColumn("release", F.expr(f"last(release, true) {over}"))
    carried = carried.withColumn("section", F.expr("last(section, true) over (partition by release.v order by n rows between unbounded preceding and current row)"))
    item = F.regexp_extract("value", r"^[-*] (.+?)\s*$", 1)
    return carried.where(item != "").select(F.col("release.v").alias("version"), F.expr("nullif(release.d, '')").alias("date"), "section", item.alias("item"), "n")


def render_changelog(items: DataFrame) -> DataFrame:
    """(version, text): each release's items as Markdown, in their order."""
    sections = items.groupBy("version", "section").agg(F.min("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "item"))), lambda s: F.concat(F.lit("- "), s["item"])), "\n").alias("body"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "section", "body"))), lambda s: F.concat(F.lit("### "), s["section"], F.lit("\n\n"), s["body"])), "\n\n")
    return sections.groupBy("version").agg(text.alias("text"))


def releases_between(items: DataFrame, last_seen: str, current: str) -> DataFrame:
    """Items of releases after the one last seen, up to the current one."""
    from shoebox.functions.text import semver

    v = semver(F.col("version"))
    return items.where((v > semver(F.lit(last_seen))) & (v <= semver(F.lit(current))))


def requirement_inventory(lines: DataFrame) -> DataFrame:
    """(name, version) from (value): pinned requirements, one a line; comments and markers are left out."""
    bare = F.trim(F.regexp_replace("value", r"[#;].*$", ""))
    return lines.select(F.lower(F.regexp_extract(bare, r"^([A-Za-z0-9._-]+)", 1)).alias("name"), F.expr("nullif(regexp_extract(value, '[=~]=\\\\s*([^\\\\s;#]+)', 1), '')").alias("version")).where("name <> ''")
