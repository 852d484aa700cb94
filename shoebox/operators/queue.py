"""A snapshot of import queues: positions, when each job ends, counts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _walk(batches):
    """When each waiting job ends, of rows (queue, id, seconds, free) by queue and place; a job of unknown length leaves its slot unknown."""
    here, free = None, None
    for b in batches:
        etas = []
        for queue, seconds, start in zip(*(b.column(c).to_pylist() for c in ("queue", "seconds", "free")), strict=True):
            if queue != here:
                here, free = queue, start
            known = [x for x in free or () if x is not None]
            end = None
            if known:
                end = None if seconds is None else min(known) + seconds
                free[free.index(min(known))] = end
            etas.append(end)
        yield pa.RecordBatch.from_arrays([b.column("queue"), b.column("id"), pa.array(etas, pa.float64())], ["queue", "id", "eta"])


def ends(jobs: DataFrame, slots: int) -> DataFrame:
    """(queue, id, eta): seconds until each active or waiting job ends.

    ``jobs`` has queue, id, status, started_at, place and seconds: what is left of an
    active job (null: unknown), or what a waiting one will take. Active jobs hold slots in
    order of their start, the last slot what is beyond; each waiting job, by place, takes
    the slot that frees first. Where an active job is paused or its rest unknown, nothing is
    known of its queue. A queue's rows meet in one task in their order and run through it, its
    slots as the state, so neither a queue's length nor the number of rows is bounded.
    """
    active = jobs.where("status in ('running', 'cancelling', 'paused')").withColumn("n", F.expr("row_number() over (partition by queue order by coalesce(started_at, timestamp'1970-01-01'), id)"))
    waiting = jobs.where("status = 'queued'").select("queue", "id", F.col("seconds").cast("double").alias("seconds"), F.expr("row_number() over (partition by queue order by place, id)").alias("n"))
    # of the jobs beyond the slots the last to start holds the last slot; a queue runs few at a time
    held = active.groupBy("queue").agg(F.array_sort(F.collect_list(F.struct("n", F.col("seconds").cast("double").alias("s")))).alias("own"), F.max(F.expr("status = 'paused' or seconds is null")).alias("blind"))
    slot = F.transform(F.sequence(F.lit(1), F.lit(slots)), lambda i: F.coalesce(F.when(i < slots, F.get("own", i - 1)["s"]).otherwise(F.try_element_at(F.filter("own", lambda o: o["n"] >= slots), F.lit(-1))["s"]), F.lit(0.0)))
    none = F.array_repeat(F.lit(0.0), slots)
    begin = jobs.select("queue").distinct().join(held.select("queue", F.when(~F.col("blind"), slot).alias("free"), "blind"), "queue", "left").select("queue", F.when(F.col("blind").isNull(), none).otherwise(F.col("free")).alias("free"))
    ordered = waiting.join(begin, "queue").select("queue", "n", F.col("id").cast("bigint").alias("id"), "seconds", "free").repartition("queue").sortWithinPartitions("queue", "n")
    walked = ordered.mapInArrow(_walk, f"queue {ordered.schema['queue'].dataType.simpleString()}, id bigint, eta double")
    known = held.select("queue", F.col("blind"))
    running = active.join(known, "queue").select("queue", F.col("id").cast("bigint").alias("id"), F.when(~F.col("blind"), F.col("seconds").cast("double")).alias("eta"))
    return walked.unionByName(running)


def snapshot(jobs: DataFrame, slots: int) -> DataFrame:
    """``ends`` with status and position (waiting jobs from 1) for all jobs, ended ones without an eta, and the queue's overall_eta: the largest, rounded half up."""
    positions = F.when(F.col("status") == "queued", F.expr("row_number() over (partition by queue, status order by place, id)")).cast("int")
    held = jobs.withColumn("position", positions).select("queue", F.col("id").cast("bigint").alias("id"), "status", "position")
    done = held.join(ends(jobs, slots), ["queue", "id"], "left")
    overall = done.groupBy("queue").agg(F.round(F.max("eta")).cast("bigint").alias("overall_eta"))
    return done.join(overall, "queue")


def counts(jobs: DataFrame) -> DataFrame:
    """(queue, running_count, queued_count, paused_count, ended_count, active_job): the active job that started first, and how many are in each state."""
    on = F.col("status").isin("running", "cancelling", "paused")
    return jobs.groupBy("queue").agg(
        F.count_if(on).alias("running_count"), F.count_if(F.col("status") == "queued").alias("queued_count"), F.count_if(F.col("status") == "paused").alias("paused_count"),
        F.count_if(F.col("status").isin("completed", "failed", "cancelled")).alias("ended_count"),
        F.min_by("id", F.when(on, F.struct(F.coalesce("started_at", F.lit("1970-01-01").cast("timestamp")), "id"))).alias("active_job"),
    )


def family_totals(stages: DataFrame) -> DataFrame:
    """(family, jobs, seconds, longest): for each family of jobs how many there are, their seconds in all, and the longest chain of stages of one job - what decides when the family ends if its jobs run side by side."""
    chain = stages.groupBy("family", "job").agg(F.sum("seconds").alias("seconds"))
    return chain.groupBy("family").agg(F.count("*").alias("jobs"), F.sum("seconds").alias("seconds"), F.max("seconds").alias("longest"))
