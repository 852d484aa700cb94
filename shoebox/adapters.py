"""The star-schema test tables seen as a photo library; the same SQL serves Spark and the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoebox.library import Library

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Rows of lineitem in a task. Their sorted keys shrink so far in a shuffle that parts of equal bytes would hold millions.
TASK_ROWS = 1_000_000

VIEWS = {
    "person": "SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, n_name AS name FROM nation",
    "cluster": "SELECT c_custkey + 1 AS id, c_mktsegment AS label, CAST(CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey + 1 END AS BIGINT) AS person_id FROM customer",
    "image": "SELECT o_orderkey + 1 AS id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS processed_at FROM orders",
    "image_location": """SELECT id, image_id, directory, filename, directory || '/' || filename AS path, created_at FROM (
        SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey + 1 AS image_id, '/lib/' || year(min(l_shipdate)) || '/' || month(min(l_shipdate)) AS directory,
          'img_' || l_orderkey || '_' || l_linenumber || '.jpg' AS filename, min(l_shipdate) AS created_at
        FROM lineitem GROUP BY l_orderkey, l_linenumber) AS located""",
    "face": """SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey + 1 AS image_id,
          min(l_quantity) AS bbox_x, min(l_extendedprice) AS bbox_y, min(l_discount) AS bbox_w, min(l_tax) AS bbox_h,
          CASE WHEN min(l_partkey) % 10 = 0 THEN NULL ELSE min(o_custkey) + 1 END AS cluster_id,
          CASE min(l_suppkey) % 10 WHEN 0 THEN 'unknown_person' WHEN 1 THEN 'not_face' ELSE 'active' END AS review_status
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_linenumber""",
}
#: How far each vector is moved towards the axis of its label, so that labels mean something.
BLEND = 1.5


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def library(spark: SparkSession, sf_dir: str) -> Library:
    """The views over one set of tables. What is grouped and joined by order is dealt into parts of about TASK_ROWS rows, so a task's share doesn't grow with the table."""
    sources = tables(spark, sf_dir, "nation", "customer", "orders", "lineitem")
    parts = -(-sources["lineitem"].count() // TASK_ROWS)
    if parts > 1:
        sources["lineitem"] = sources["lineitem"].repartition(parts, "l_orderkey")
    return Library(**{name: spark.sql(_named(sql, sources), **sources) for name, sql in VIEWS.items()})


def _named(sql: str, sources: dict[str, DataFrame]) -> str:
    """Table names as parameters of the SQL text, so that no session-wide view is made."""
    for n in sources:
        sql = sql.replace(f"FROM {n}", "FROM {" + n + "}").replace(f"JOIN {n}", "JOIN {" + n + "}")
    return sql


def with_views(sql: str, *names: str) -> str:
    """Oracle SQL over the library's views."""
    return "WITH " + ", ".join(f'"{n}" AS ({VIEWS[n]})' for n in names or VIEWS) + " " + sql


VECTORS = f"""SELECT vec_id + 1 AS id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM (
    SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x, i: x + CASE WHEN i = label + 1 THEN {BLEND} ELSE 0.0 END) AS v FROM embeddings)"""
FACE_VECTORS = f"""SELECT id, CAST(label * 3 + (id - 1) % 3 + 1 AS BIGINT) AS cluster_id, CAST(CASE WHEN label >= 7 THEN NULL ELSE label + 1 END AS BIGINT) AS person_id,
    CASE WHEN (id - 1) % 11 = 0 THEN 'unknown_person' WHEN (id - 1) % 11 = 1 THEN 'not_face' ELSE 'active' END AS status,
    list_transform(v, lambda x: x / norm) AS vec FROM ({VECTORS})"""


def face_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, cluster_id, person_id, status, vec): unit vectors blended with their label."""
    from pyspark.sql import functions as F

    from shoebox.functions.vector import normalized

    raw = tables(spark, sf_dir, "embeddings")["embeddings"]
    blended = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: x + F.when(i == F.col("label"), BLEND).otherwise(0.0))
    n = F.col("vec_id")
    return raw.select(
        (n + 1).alias("id"), (F.col("label") * 3 + n % 3 + 1).cast("bigint").alias("cluster_id"),
        F.when(F.col("label") < 7, F.col("label") + 1).cast("bigint").alias("person_id"),
        F.when(n % 11 == 0, "unknown_person").when(n % 11 == 1, "not_face").otherwise("active").alias("status"), normalized(blended).alias("vec"),
    )
