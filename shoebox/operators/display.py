"""What a gallery shows: lanes of labels, lists that keep their order, runs of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.storage import numbered, settled

#: The text of a face without a person, width of a picture as shown, of a character and of a badge's frame, the widest badge in percent.
NOBODY, SHOWN, CHARACTER, FRAME, WIDEST = "Nicht zugewiesen", 420, 6.2, 34, 62.0


def badge_percent(person_name: Column) -> Column:
    """The width of a face's badge, in percent of the picture."""
    text = F.when(F.coalesce(person_name, F.lit("")) == "", F.lit(NOBODY)).otherwise(person_name)
    return F.least(F.lit(WIDEST), (F.length(text) * CHARACTER + FRAME) / SHOWN * 100)


def label_lanes(faces: DataFrame, lanes: int = 3) -> DataFrame:
    """(image_id, id, lane) of ``faces`` (image_id, id, bbox_x, person_name, natural_width): from the left, ties by id, each badge takes the first lane that is free where it begins.

    Where none is, a further lane opens, and where all are open the one that frees first is
    taken. Pictures without a width have one lane. An image's faces are few: they are
    folded with the ends of its lanes as state.
    """
    start = F.when(F.coalesce(F.col("natural_width"), F.lit(0)) != 0, F.col("bbox_x") / F.col("natural_width") * 100)
    badge = F.struct(F.col("bbox_x"), F.col("id"), start.alias("start"), (start + badge_percent(F.col("person_name"))).alias("end"))
    held = faces.groupBy("image_id").agg(F.array_sort(F.collect_list(badge)).alias("badges"))

    def step(s: Column, b: Column) -> Column:
        ends = s["ends"]
        free = F.array_position(F.transform(ends, lambda e: e <= b["start"]), True).cast("int")
        soonest = F.array_position(ends, F.array_min(ends)).cast("int")
        at = F.when(free > 0, free).when(F.size(ends) < lanes, F.size(ends) + 1).otherwise(soonest)
        grown = F.when(at > F.size(ends), F.concat(ends, F.array(F.greatest(F.lit(0.0), b["end"]))))
        kept = F.transform(ends, lambda e, i: F.when(i == at - 1, F.greatest(e, b["end"])).otherwise(e))
        lane = F.when(b["start"].isNull(), 0).otherwise(at - 1)
        return F.struct(F.coalesce(grown, kept).alias("ends"), F.concat(s["out"], F.array(F.struct(b["id"].alias("id"), lane.cast("int").alias("lane")))).alias("out"))

    zero = F.struct(F.array().cast("array<double>").alias("ends"), F.array().cast("array<struct<id:bigint,lane:int>>").alias("out"))
    return held.select("image_id", F.explode(F.aggregate("badges", zero, step)["out"]).alias("o")).select("image_id", "o.id", "o.lane")


def merged_list(current: DataFrame, page: DataFrame) -> DataFrame:
    """``page`` (id, place, ...) with its place ``n`` in a list where rows of ``current`` (id, place) come first, in their old order, and arrivals after them in the page's; ``known`` tells them apart.

    Rows that the page lacks are gone; of an id that current has twice the first place counts.
    """
    old = current.groupBy("id").agg(F.min("place").alias("old_place"))
    both = page.join(old, "id", "left").withColumn("known", F.col("old_place").isNotNull())
    return numbered(both.withColumn("_new", ~F.col("known")), "_new", "old_place", "place", "id").drop("_new", "old_place")


def runs(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Add ``run``, from 0: rows that follow one another by ``order`` with an equal ``key`` (nulls are equal) share one.

    A key that comes back later begins another run. Rows are dealt into ranges; a task sees
    where runs begin among its own, and one row for each range - its first and last key and how
    many runs begin in it - says whether a run goes on across the border.
    """
    ranged = settled(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    by = f"partition by _part order by {', '.join(order)}"
    local = settled(ranged.withColumn("_n", F.expr(f"row_number() over ({by})")).withColumn("_fresh", F.expr(f"int(row_number() over ({by}) > 1 and not (lag({key}) over ({by}) <=> {key}))")))
    whole = F.struct(F.col(key).alias("k"))
    ends = local.groupBy("_part").agg(F.min_by(whole, "_n").alias("_first"), F.max_by(whole, "_n").alias("_last"), F.sum("_fresh").alias("_inside"))
    # one row for each range from here on
    crossed = ends.withColumn("_new", F.expr("int(row_number() over (order by _part) > 1 and not (lag(_last) over (order by _part).k <=> _first.k))"))
    before = crossed.select("_part", F.expr("sum(_new) over (order by _part) + sum(_inside) over (order by _part) - _inside").alias("_before"))
    counted = local.withColumn("_within", F.expr(f"sum(_fresh) over ({by})"))
    return counted.join(before, "_part").withColumn("run", (F.col("_before") + F.col("_within")).cast("bigint")).select(*rows.columns, "run")
