"""A library as named DataFrames, its snapshots on disk, and its invariants."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.schemas import SCHEMAS, conform

REQUIRED = ("person", "cluster", "image", "face")
#: Columns without which a table is of no use.
NEEDED = {"person": ("id", "name"), "cluster": ("id", "person_id"), "image": ("id",), "face": ("id", "image_id", "cluster_id")}


@dataclass(frozen=True)
class Library:
    """The tables of a library; operations return another one and change none."""

    person: DataFrame
    cluster: DataFrame
    image: DataFrame
    image_location: DataFrame
    face: DataFrame
    cluster_person_suggestion: DataFrame | None = None
    cluster_review_suggestion: DataFrame | None = None
    recluster_dirty_person: DataFrame | None = None

    def with_tables(self, **tables: DataFrame) -> Library:
        return replace(self, **tables)

    def tables(self) -> dict[str, DataFrame]:
        return {k: v for k, v in vars(self).items() if v is not None}


def write_tables(lib: Library, path: str, version: int) -> None:
    for name, df in lib.tables().items():
        df.write.mode("overwrite").parquet(f"{path}/v={version}/{name}")


def mark_version(spark: SparkSession, path: str, version: int) -> None:
    """From now on readers follow this version."""
    spark.range(1).select(F.lit(version).cast("bigint").alias("version"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(f"{path}/versions")


def write_snapshot(lib: Library, path: str, version: int) -> str:
    """Write every table as a new version; the marker of the last written version is what readers follow."""
    write_tables(lib, path, version)
    mark_version(lib.face.sparkSession, path, version)
    return f"{path}/v={version}"


def current_version(spark: SparkSession, path: str) -> int | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{path}/versions").agg(F.max("version")).first()[0]
    except AnalysisException:
        return None


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> Library:
    """The newest readable version, or the one asked for. Required tables must be there; others may be missing."""
    from pyspark.errors import AnalysisException

    version = current_version(spark, path) if version is None else version
    if version is None:
        raise ValueError(f"no snapshot at {path}")
    found = {}
    for name in Library.__dataclass_fields__:
        try:
            found[name] = conform(spark.read.option("mergeSchema", "true").parquet(f"{path}/v={version}/{name}"), name)
        except AnalysisException as e:
            if name in REQUIRED:
                raise ValueError(f"snapshot {version} has no table {name}") from e
            found[name] = spark.createDataFrame([], SCHEMAS[name])
    return Library(**found)


def problems(tables: dict[str, DataFrame]) -> list[str]:
    """What is wrong with the tables of a snapshot: missing ones, missing columns, repeated or missing ids, faces of no image. Each table is read whole."""
    found = [f"no table {n}" for n in REQUIRED if n not in tables]
    for name, columns in NEEDED.items():
        if name in tables:
            found += [f"no column {name}.{c}" for c in columns if c not in tables[name].columns]
    if found:
        return found
    for name in REQUIRED:
        n, ids = tables[name].agg(F.count("*"), F.count_distinct("id")).first()
        if n != ids:
            found.append(f"ids of {name} are not unique")
    if tables["face"].join(tables["image"].select(F.col("id").alias("image_id")), "image_id", "left_anti").limit(1).count():
        found.append("faces of no image")
    for name, df in tables.items():
        if name not in REQUIRED:
            df.agg(*(F.count(c) for c in df.columns)).first()  # a damaged file shows when it is read
    return found


def import_foreign(spark: SparkSession, source: str, path: str) -> int:
    """Put the library at ``source``, a folder of tables of any version, in place of the one at ``path``: the number of the new version.

    It is checked, brought to today's schema, repaired and written aside, read back and
    checked again; then the marker of versions moves, which is the one thing that readers
    follow. Whatever fails or is lost before that leaves the old library as it is, and
    its versions stay for ``recover``. A fault of the source raises ValueError.
    """
    from shoebox.migrations import migrate
    from shoebox.operators.mutations import repair

    found = {}
    for name in Library.__dataclass_fields__:
        df = _table(spark, f"{source}/{name}")
        if df is not None:
            found[name] = df
    if "face" in found and "image_path" in found["face"].columns:  # faces of paths: their images are made
        wrong = [f"no table {n}" for n in ("person", "cluster") if n not in found]
    else:
        wrong = problems(found)
    if wrong:
        raise ValueError("; ".join(wrong))
    lib = repair(migrate(found)[0])
    version = (current_version(spark, path) or 0) + 1
    write_tables(lib, path, version)
    again = problems({n: spark.read.parquet(f"{path}/v={version}/{n}") for n in lib.tables()})
    if again:
        raise ValueError("; ".join(again))
    mark_version(spark, path, version)
    return version


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException:
        return None


def recover(spark: SparkSession, path: str) -> Library:
    """The newest version all of whose tables can be read and hold together; others are passed over, one at a time."""
    versions = [r[0] for r in spark.read.parquet(f"{path}/versions").select("version").distinct().orderBy(F.desc("version")).collect()]
    for v in versions:
        try:
            lib = read_snapshot(spark, path, v)
            if not problems(lib.tables()):
                return lib
        except Exception:  # noqa: BLE001, S112 - a damaged version may fail in any way
            continue
    raise ValueError(f"no readable snapshot at {path}")


def violations(lib: Library) -> DataFrame:
    """(rule, id) for every row that breaks an invariant."""
    face, cluster, person = lib.face, lib.cluster, lib.person
    rule = lambda name, df: df.select(F.lit(name).alias("rule"), F.col(df.columns[0]).cast("bigint").alias("id"))
    found = [
        rule("empty_cluster", cluster.select("id").join(face.select(F.col("cluster_id").alias("id")), "id", "left_anti")),
        rule("missing_cluster", face.where("cluster_id is not null").select(F.col("cluster_id").alias("id")).distinct().join(cluster.select("id"), "id", "left_anti")),
        rule("broken_person", cluster.where("person_id is not null").join(person.select(F.col("id").alias("person_id")), "person_id", "left_anti").select("id")),
        rule("no_location", lib.image.select("id").join(lib.image_location.select(F.col("image_id").alias("id")), "id", "left_anti")),
        rule("name_repeated", person.groupBy(F.lower(F.trim("name")).alias("k")).agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n > 1").select("id")),
    ]
    if "content_hash" in lib.image.columns:
        found.append(rule("hash_repeated", lib.image.where("content_hash is not null").groupBy("content_hash").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n > 1").select("id")))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out
