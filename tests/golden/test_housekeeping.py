import duckdb
import pytest
from pyspark.sql import functions as F

from shoebox.adapters import TABLES
from shoebox.operators import housekeeping as H
from shoebox.plans import registry

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["settings_snapshots", "changelog_problems", "finished_tasks", "progress_eta", "cluster_totals"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = registry.queries()[name](spark, DIR)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple(str(x) for x in r)
    assert want and sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(want, key=key)


def test_settings_of_an_empty_table_are_defaults(spark):
    (row,) = H.settings_snapshot(spark.createDataFrame([], "key string, value string")).collect()
    assert (row.ui_theme, row.file_log_level, row.automatic_update_checks, row.cluster_distance_threshold) == ("system", "ERROR", True, 0.5)
    assert row.filename_person_suffix_format == "DATEI Name 1, Name 2.jpg"


def test_suffix_format(spark):
    df = spark.createDataFrame([(" - {names} ",)], "v string")
    assert df.select(H.suffix_format(F.col("v"))).first()[0] == "- {names}"
    with pytest.raises(Exception, match="placeholder"):
        spark.createDataFrame([("plain",)], "v string").select(H.suffix_format(F.col("v"))).collect()


def test_a_valid_changelog_has_no_problems(spark):
    rows = [(1, "Unreleased", None, ["Neu"]), (2, "1.2.0", "2024-02-29", ["Neu", "Behoben"]), (3, "1.1.0", "2023-12-01", None)]
    df = spark.createDataFrame(rows, "n int, version string, date string, sections array<string>")
    assert H.changelog_problems(df).count() == 0
    assert H.changelog_problems(df.where("false")).count() == 0


def test_finished_tasks_without_time_come_last(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 5, "b"), (2, 9, "c"), (3, 7, "d")], "id int, finished_at int, name string")
    assert [tuple(r) for r in H.finished_tasks(df, 3).collect()] == [(2, 9, "c"), (3, 7, "d"), (1, None, "a")]
