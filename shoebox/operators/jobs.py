"""Import jobs: history, throughput and completion estimates."""

from __future__ import annotations

import math
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight of a new rate, window and clamp of live samples, time constants of a corrected estimate.
ALPHA, LIVE, LOW, HIGH, SLOWER, FASTER = 0.25, 25, 0.4, 2.5, 75.0, 20.0


def ewma(samples: Column, alpha: float = ALPHA) -> Column:
    """Exponentially weighted mean of an ordered array; the first sample starts it."""
    return F.aggregate(F.slice(samples, 2, F.greatest(F.size(samples), F.lit(1))), F.element_at(samples, 1), lambda m, x: m * (1 - alpha) + x * alpha)


def rates(samples: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The weighted mean rate of each group of samples, in their order."""
    held = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value])
    return samples.groupBy(*keys).agg(held.alias("samples")).select(*keys, ewma(F.col("samples")).alias("rate"), F.size("samples").alias("samples"))


def trim_history(jobs: DataFrame, keep: int) -> DataFrame:
    """Finished jobs beyond the newest ``keep`` go; others stay."""
    ended = F.col("status").isin("completed", "failed", "cancelled")
    # only the newest of the ended need an order: a bounded top-k
    newest = jobs.where(ended).orderBy(F.desc("queue_order"), F.desc("id")).limit(max(0, keep)).select("id")
    return jobs.where(~ended).unionByName(jobs.where(ended).join(newest, "id", "left_semi"))


def recover_jobs(jobs: DataFrame) -> DataFrame:
    """After a restart: running and cancelling jobs wait again with their counters at zero; paused ones stay."""
    again = F.col("status").isin("running", "cancelling")
    counters = [c for c in ("total_images", "hashed_images", "processed_images", "total_faces", "processed_faces", "stage_current", "stage_total") if c in jobs.columns]
    return jobs.withColumns({c: F.when(again, 0).otherwise(F.col(c)).cast("int") for c in counters} | {"status": F.when(again, "queued").otherwise(F.col("status"))})


def queue_positions(jobs: DataFrame) -> DataFrame:
    """(id, position): waiting jobs from 1, in queue order."""
    return jobs.where("status = 'queued'").select("id", F.expr("row_number() over (order by queue_order, id)").alias("position"))


def view_order() -> list[Column]:
    """Running jobs, then waiting ones by position, then the rest, newest first."""
    kind = F.when(F.col("status").isin("running", "cancelling"), 0).when(F.col("status") == "queued", 1).otherwise(2)
    return [kind, F.when(kind == 1, F.col("queue_order")).otherwise(-F.col("queue_order")), F.col("id")]


def live_rate(samples: pd.DataFrame) -> float | None:
    """Median seconds per unit of the last samples (at, progress), each clamped to the median before it."""
    kept: list[float] = []
    last_at = last = None
    for at, progress in samples[["at", "progress"]].itertuples(index=False):
        if last is None or progress < last:
            kept, last_at, last = [], at, progress
        elif progress > last:
            one = max(0.0, at - last_at) / (progress - last)
            if one > 0:
                if kept:
                    middle = median(kept)
                    one = min(max(one, LOW * middle), HIGH * middle)
                kept = [*kept, one][-LIVE:]
            last_at, last = at, progress
    return median(kept) if kept else None


def eased(targets: pd.DataFrame) -> list[float]:
    """A countdown that follows targets (at, seconds): slowly up, faster down."""
    shown: list[float] = []
    last = None
    for at, seconds in targets[["at", "seconds"]].itertuples(index=False):
        if last is None:
            shown.append(float(seconds))
        else:
            gone = max(0.0, at - last)
            count = max(0.0, shown[-1] - gone)
            off = seconds - count
            shown.append(max(0.0, count + off * (1 - math.exp(-gone / (SLOWER if off > 0 else FASTER)))))
        last = at
    return shown


def live_rates(samples: DataFrame) -> DataFrame:
    """(job, rate) from (job, at, progress); a job's samples are few."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"job": [pdf["job"].iloc[0]], "rate": [live_rate(pdf.sort_values("at"))]})

    return samples.groupBy("job").applyInPandas(one, "job string, rate double")


def eased_estimates(targets: DataFrame) -> DataFrame:
    """(job, at, seconds) with the seconds as shown, from raw ones."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        return pdf.assign(seconds=eased(pdf))

    return targets.groupBy("job").applyInPandas(one, "job string, at double, seconds double")


def makespan(jobs: DataFrame, slots: int) -> DataFrame:
    """(queue, id, eta): when each job of a queue ends on so many slots, each taking the slot that frees first.

    ``jobs`` has queue, id, place and seconds; a fold over the queue's own jobs, in order.
    """
    least = lambda a: F.array_position(a, F.array_min(a)).cast("int")

    def step(s: Column, j: Column) -> Column:
        at = least(s["free"])
        end = F.array_min(s["free"]) + j["seconds"]
        free = F.transform(s["free"], lambda x, i: F.when(i == at - 1, end).otherwise(x))
        return F.struct(free.alias("free"), F.concat(s["ends"], F.array(F.struct(j["id"].alias("id"), end.alias("eta")))).alias("ends"))

    start = F.struct(F.array_repeat(F.lit(0.0), slots).alias("free"), F.array().cast("array<struct<id:bigint,eta:double>>").alias("ends"))
    folded = jobs.groupBy("queue").agg(F.array_sort(F.collect_list(F.struct("place", F.col("id").cast("bigint").alias("id"), F.col("seconds").cast("double").alias("seconds")))).alias("jobs"))
    return folded.select("queue", F.explode(F.aggregate("jobs", start, step)["ends"]).alias("e")).select("queue", "e.id", "e.eta")
