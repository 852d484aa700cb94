"""Settings, changelog checks, finished tasks, progress and totals of clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.functions.text import BLOCK, JOINER
from shoebox.library import Library
from shoebox.operators import relational as R

#: Themes and log levels with their defaults, words that switch off, the default threshold, sections of a changelog.
THEMES, THEME = ("system", "light", "dark"), "system"
LOG_LEVELS, LOG_LEVEL = ("DEBUG", "INFO", "WARNING", "ERROR"), "ERROR"
OFF = ("0", "false", "no", "off")
THRESHOLD = 0.5
SECTIONS = ("Neu", "Verbessert", "Behoben")
UNRELEASED = "Unreleased"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def theme(value: Column) -> Column:
    """A known theme in lower case; the default for any other value."""
    v = F.lower(_stripped(value))
    return F.when(v.isin(*THEMES), v).otherwise(THEME)


def log_level(value: Column) -> Column:
    """A known log level in upper case; the default for any other value."""
    v = F.upper(_stripped(value))
    return F.when(v.isin(*LOG_LEVELS), v).otherwise(LOG_LEVEL)


def switched_on(value: Column) -> Column:
    """Whether a stored switch is on: everything but the words of OFF is, a null too."""
    return ~F.coalesce(F.lower(_stripped(value)).isin(*OFF), F.lit(False))


def suffix_format(value: Column) -> Column:
    """A format of names, stripped; one without the placeholder ends the query."""
    v = _stripped(F.coalesce(value, F.lit("")))
    return F.when(v.contains("{names}"), v).otherwise(F.raise_error(F.lit("a suffix format needs the placeholder {names}")).cast("string"))


def settings_snapshot(settings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row of effective settings from (key, value), or one for each value of the columns ``by``.

    Unknown keys are ignored; missing, null and unreadable values take their defaults.
    Without ``by`` an empty table gives one row of defaults.
    """
    of = lambda key: F.max(F.when(F.col("key") == key, F.col("value"))).alias(key)
    keys = ("cluster_distance_threshold", "filename_person_block_separator", "filename_person_joiner", "file_log_level", "ui_theme", "automatic_update_checks")
    held = settings.groupBy(*by).agg(*map(of, keys))
    block, joiner = (F.coalesce(c, F.lit(d)) for c, d in (("filename_person_block_separator", BLOCK), ("filename_person_joiner", JOINER)))
    threshold = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("cluster_distance_threshold").try_cast("double"), F.lit(THRESHOLD))))
    summary = F.concat(F.lit("DATEI"), block, F.lit("Name 1"), joiner, F.lit("Name 2.jpg"))
    return held.select(
        *by, threshold.alias("cluster_distance_threshold"), (1 - threshold).alias("clustering_strictness"), summary.alias("filename_person_suffix_format"),
        block.alias("filename_person_block_separator"), joiner.alias("filename_person_joiner"), log_level(F.col("file_log_level")).alias("file_log_level"),
        theme(F.col("ui_theme")).alias("ui_theme"), switched_on(F.col("automatic_update_checks")).alias("automatic_update_checks"),
    )


def changelog_problems(releases: DataFrame, sections: Sequence[str] = SECTIONS) -> DataFrame:
    """(n, version, problem) from releases (n, version, date, sections), n being their order: whatever a valid changelog may not have.

    The first release is the unreleased one, which has no date; all others have a version of three
    numbers and an ISO date. No version comes twice, and a release has each of the known sections once at most.
    """
    first = releases.groupBy("version").agg(F.min("n").alias("_first"))
    start = releases.agg(F.min("n").alias("_start"))  # one row
    r = releases.join(first, "version", "left").join(F.broadcast(start))
    open_, known = F.col("version") == UNRELEASED, F.coalesce("sections", F.array().cast("array<string>"))
    checks = {
        "not unreleased first": (F.col("n") == F.col("_start")) & ~open_, "unreleased not first": open_ & (F.col("n") > F.col("_start")),
        "unreleased has date": open_ & F.col("date").isNotNull(), "duplicate version": F.col("n") > F.col("_first"),
        "invalid version": ~open_ & ~F.col("version").rlike(r"^\d+\.\d+\.\d+$"), "missing date": ~open_ & F.col("date").isNull(),
        "invalid date": ~open_ & F.col("date").isNotNull() & F.col("date").try_cast("date").isNull(),
        "duplicate section": F.size(known) > F.size(F.array_distinct(known)), "unknown section": F.size(F.array_except(known, F.array(*map(F.lit, sections)))) > 0,
    }
    found = F.array_compact(F.array(*(F.when(hit, name) for name, hit in checks.items())))
    return r.select("n", "version", F.explode(found).alias("problem"))


def finished_tasks(tasks: DataFrame, most: int = 8) -> DataFrame:
    """The newest ``most`` of the finished tasks (id, finished_at, ...), each once: its last entry; tasks without a time come last, ties by id."""
    others = [c for c in tasks.columns if c != "id"]
    last = tasks.groupBy("id").agg(F.max(F.struct("finished_at", *(c for c in others if c != "finished_at"))).alias("r"))
    return last.select("id", *(F.col(f"r.{c}").alias(c) for c in others)).orderBy(F.desc_nulls_last("finished_at"), "id").limit(most)


def progress(current: Column, total: Column) -> Column:
    """Per cent done, from 0 to 100; null where there is nothing to do."""
    return F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), current / total * 100)))


def remaining_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds that the rest takes at the rate so far; null before anything is done, 0 once all is."""
    rate = done / F.greatest(elapsed, F.lit(1.0))
    known = (done > 0) & (total > 0) & elapsed.isNotNull() & ~F.isnan(elapsed.cast("double"))
    return F.when(known, F.when(done >= total, 0.0).otherwise((total - done) / rate))


def cluster_totals(lib: Library) -> DataFrame:
    """One row: clusters of nobody and of people, different names of people, archived faces."""
    name = F.nullif(F.trim(F.coalesce("person_name", F.lit(""))), F.lit(""))
    named = R.cluster_summaries(lib).groupBy(name.alias("name")).agg(F.count("*").alias("n"))
    some = F.col("name").isNotNull()
    clusters = named.agg(F.coalesce(F.sum(F.when(~some, F.col("n"))), F.lit(0)).alias("open_clusters"), F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0)).alias("assigned_clusters"), F.count_if(some).alias("assigned_persons"))
    archived = lib.face.agg(F.count_if(F.col("review_status") != "active").alias("archived_faces"))
    return clusters.join(archived)  # each side is one row
