"""Release payloads: JSON of a release list as VARIANT columns, the installer that fits, and its digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.functions.text import semver

#: What follows the version in an installer's name, and the mark of a variant.
EXTENSION, MARKS = ".exe", {"cpu": "", "gpu": "-GPU"}
_ASSET = "array<struct<name:string,browser_download_url:string,digest:string>>"


def release_candidates(payloads: DataFrame, current: str, installer: str, variant: str = "cpu") -> DataFrame:
    """``payloads`` (id, payload) as (id, version, update_available, installer_name, installer_url, digest, checksum_url, published_at, problem).

    ``installer`` begins an installer's name. It is the asset of the release's version and the
    variant, and counts only with its checksum beside it. problem says what is wrong: ``unreadable``, ``unreleased``
    (a draft or a trial), ``version``, ``no installer``; null where nothing is.
    """
    read = payloads.select("id", F.try_parse_json("payload").alias("v"))
    of = lambda path, kind="string": F.try_variant_get("v", path, kind)
    wide = read.select("id", F.col("v").isNull().alias("_bad"), F.trim(of("$.tag_name")).alias("_tag"), F.coalesce(of("$.draft", "boolean"), F.lit(False)).alias("_draft"), F.coalesce(of("$.prerelease", "boolean"), F.lit(False)).alias("_trial"), of("$.published_at").alias("published_at"), F.coalesce(of("$.assets", _ASSET), F.array().cast(_ASSET)).alias("_assets"))
    numbers = semver(F.col("_tag"))
    wide = wide.withColumn("_n", numbers).withColumn("version", F.array_join(F.col("_n").cast("array<string>"), "."))
    name = F.concat(F.lit(installer + MARKS[variant] + "-"), F.col("version"), F.lit(EXTENSION))
    pick = lambda n: F.try_element_at(F.filter("_assets", lambda a: a["name"] == n), F.lit(-1))
    wide = wide.withColumn("_name", name).withColumn("_exe", pick(F.col("_name"))).withColumn("_sum", pick(F.concat(F.col("_name"), F.lit(".sha256"))))
    problem = F.when(F.col("_bad"), "unreadable").when(F.col("_draft") | F.col("_trial"), "unreleased").when(F.col("_n").isNull(), "version").when(F.col("_exe").isNull() | F.col("_sum").isNull(), "no installer")
    ok = F.col("problem").isNull()
    return wide.withColumn("problem", problem).select(
        "id", F.when(F.coalesce(F.col("problem"), F.lit("")).isin("", "no installer"), F.col("version")).alias("version"),
        F.when(F.coalesce(F.col("problem"), F.lit("")).isin("", "no installer"), F.col("_n") > semver(F.lit(current))).alias("update_available"),
        F.when(ok, F.col("_name")).alias("installer_name"), F.when(ok, F.col("_exe.browser_download_url")).alias("installer_url"), F.when(ok, F.coalesce("_exe.digest", F.lit(""))).alias("digest"),
        F.when(ok, F.col("_sum.browser_download_url")).alias("checksum_url"), "published_at", "problem",
    )


def verified(files: DataFrame, published: DataFrame) -> DataFrame:
    """(name, sha256, problem): ``files`` (name, content or sha256) held against ``published`` (name, text, digest).

    text is a checksum list's line, of which the first 64 hex digits count and which must
    name the file; digest, where there is one, must say the same. problem is ``unpublished``,
    ``invalid checksum``, ``contradiction``, ``wrong checksum``, or null.
    """
    own: Column = F.sha2("content", 256) if "content" in files.columns else F.lower("sha256")
    held = files.select("name", own.alias("sha256")).join(published.select("name", "text", F.coalesce("digest", F.lit("")).alias("digest"), F.lit(True).alias("_there")), "name", "left")
    named = F.regexp_extract(F.coalesce("text", F.lit("")), "([0-9a-fA-F]{64})", 1)
    wanted = F.when((named != "") & F.col("text").contains(F.col("name")), F.lower(named))
    apart = (F.col("digest") != "") & ~(F.lower("digest").eqNullSafe(F.concat(F.lit("sha256:"), F.col("_sum"))))
    held = held.withColumn("_sum", wanted)
    problem = F.when(F.col("_there").isNull(), "unpublished").when(F.col("_sum").isNull(), "invalid checksum").when(apart, "contradiction").when(~F.col("sha256").eqNullSafe(F.col("_sum")), "wrong checksum")
    return held.select("name", "sha256", problem.alias("problem"))


def release_sections(bodies: DataFrame) -> DataFrame:
    """(id, place, title, item): the items of a release text (id, body), each under the last title above it; items without one, and titles without items, are left out."""
    lines = bodies.select("id", F.posexplode(F.split(F.coalesce("body", F.lit("")), "\\R")).alias("place", "line")).withColumn("line", F.trim("line"))
    titled = lines.withColumn("title", F.expr("last(if(startswith(line, '## '), trim(substr(line, 4)), null), true) over (partition by id order by place)"))
    return titled.where(F.col("line").startswith("- ") & F.col("title").isNotNull()).select("id", "place", "title", F.trim(F.expr("substr(line, 3)")).alias("item"))
