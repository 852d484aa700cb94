"""Tables, enumerations and settings of a photo library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: States of a face, of a suggestion and of a job, names of review groups, and the name of people without one.
FACE_STATUSES = ("active", "unknown_person", "not_face")
SUGGESTION_STATUSES = ("pending", "dismissed")
JOB_STATUSES = ("queued", "running", "paused", "cancelling", "completed", "failed", "cancelled")
REVIEW_GROUPS = {"unassigned": "Nicht zugewiesen", "unknown_person": "Unbekannte Personen", "not_face": "Keine Gesichter"}
UNKNOWN = "Unbekannt"

_SQL = {
    "person": "id bigint, name string",
    "cluster": "id bigint, label string, person_id bigint",
    "image": "id bigint, path string, directory string, filename string, content_hash string, processed_at timestamp",
    "image_location": "id bigint, image_id bigint, path string, directory string, filename string, created_at timestamp, file_size bigint, modified_at_ns bigint",
    "face": "id bigint, image_id bigint, bbox_x double, bbox_y double, bbox_w double, bbox_h double, cluster_id bigint, review_status string, embedding array<float>",
    "cluster_person_suggestion": "cluster_id bigint, person_id bigint, confidence double, best_distance double, runner_up_margin double, support_ratio double, support_count int, face_count int, status string, updated_at timestamp",
    "cluster_review_suggestion": "cluster_id bigint, review_status string, confidence double, best_distance double, support_ratio double, support_count int, face_count int, status string, updated_at timestamp",
    "import_job": "id string, folder_path string, status string, created_at timestamp, started_at timestamp, finished_at timestamp, stage_started_at timestamp, total_images int, hashed_images int, processed_images int, total_faces int, processed_faces int, stage string, stage_current int, stage_total int, current_file string, last_error string, queue_order int",
    "app_settings": "key string, value string",
    "recluster_dirty_person": "person_id bigint",
}
_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "timestamp": T.TimestampType(), "array<float>": T.ArrayType(T.FloatType())}
SCHEMAS: dict[str, T.StructType] = {name: T.StructType([T.StructField(c.split()[0], _TYPES[c.split()[1]]) for c in ddl.split(", ")]) for name, ddl in _SQL.items()}


def conform(df: DataFrame, table: str) -> DataFrame:
    """The columns of a table in order: missing ones null, others dropped, an invalid face status active."""
    held = set(df.columns)
    out = df.select(*((F.col(f.name) if f.name in held else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[table]))
    if table == "face":
        out = out.withColumn("review_status", F.when(F.col("review_status").isin(*FACE_STATUSES), F.col("review_status")).otherwise("active"))
    return out


def clustering_profile(threshold: float = 0.5, stored: dict[str, str] | None = None) -> dict[str, float]:
    """The clustering settings: derived from one threshold, overlaid by stored values that parse."""
    t = min(1.0, max(0.0, threshold))
    profile = {
        "cluster_distance_threshold": t, "cluster_cohesion_threshold": t, "cluster_person_anchor_threshold": min(0.48, 0.70 * t),
        "cluster_ambiguity_margin": max(0.055, 0.09 * t), "cluster_support_ratio": 0.80, "cluster_outlier_threshold": min(1.0, 1.12 * t),
    }
    for k in profile.keys() & (stored or {}).keys():
        try:
            profile[k] = float(stored[k])
        except ValueError:
            continue
    return profile | {"strictness": min(1.0, max(0.0, 1 - profile["cluster_distance_threshold"]))}
