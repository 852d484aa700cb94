"""The library's streams: latest values, throttles, debounces, duplicates, ingest and online grouping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.operators.clustering import Assigner


def timed(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events with a time column that streams can watermark: NTZ times are taken as the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def latest_per_topic(events: DataFrame) -> DataFrame:
    """(topic, payload, at): the newest payload of each topic; for the update or complete mode."""
    return events.groupBy("topic").agg(F.max_by("payload", "ts").alias("payload"), F.max("ts").alias("at"))


def throttled(events: DataFrame, every: str = "200 milliseconds") -> DataFrame:
    """(topic, window, payload): the last payload of each topic and window."""
    return events.groupBy("topic", F.window("ts", every).alias("window")).agg(F.max_by("payload", "ts").alias("payload"))


def debounced(events: DataFrame, quiet: str = "90 seconds") -> DataFrame:
    """(topic, fires_at, reason, n): one row for each run of events that a quiet time ends, with its last reason."""
    return events.groupBy("topic", F.session_window("ts", quiet).alias("s")).agg(F.max_by("payload", "ts").alias("reason"), F.count("*").alias("n")).select("topic", F.col("s.end").alias("fires_at"), "reason", "n")


def first_of_content(files: DataFrame) -> DataFrame:
    """Files whose content hash wasn't met within the watermark."""
    return files.dropDuplicatesWithinWatermark(["content_hash"])


def sse_frame(topic, payload):
    """A server-sent-event frame of a topic and a struct."""
    return F.concat(F.lit("event: "), topic, F.lit("\ndata: "), F.to_json(payload), F.lit("\n\n"))


def progress_deltas(progress: DataFrame) -> DataFrame:
    """(job, grew): how far each job's counter grew in a micro-batch, against the state of the last one; a counter that falls starts anew."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        now = max(int(f["progress"].max()) for f in frames)
        state.update((now,))
        yield pd.DataFrame({"job": [key[0]], "grew": [now - last if now >= last else now]})

    return progress.groupBy("job").applyInPandasWithState(step, "job string, grew bigint", "last bigint", "update", "NoTimeout")


def online_groups(faces: DataFrame, threshold: float) -> DataFrame:
    """(pool, id, cluster_id): faces grouped as they arrive; each pool's vectors and labels are its state."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        work = Assigner(threshold, persons=False)
        if state.exists:
            raw, labels, width = state.get
            work.load(np.frombuffer(raw, np.float64).reshape(-1, width), labels)
        rows = pd.concat(list(frames)).sort_values("id")
        labels = [work.add(np.asarray(v, np.float64)) for v in rows["vec"]]
        state.update((work.rows.tobytes(), [int(x) for x in work.labels], len(work.rows[0])))
        yield pd.DataFrame({"pool": key[0], "id": rows["id"], "cluster_id": labels})

    return faces.groupBy("pool").applyInPandasWithState(step, "pool bigint, id bigint, cluster_id bigint", "rows binary, labels array<bigint>, width int", "append", "NoTimeout")


def ingest(files: DataFrame, sink: Callable[[DataFrame, int], None], known: Callable[[], DataFrame], checkpoint: str):
    """Start a stream that hands on new or changed files, micro-batch by micro-batch, once each.

    ``files`` is a stream of (path, file_size, modified_at_ns, ...), ``known`` reads what is
    stored now, ``sink`` writes a batch and must bear repeats of a batch number.
    """
    from shoebox.operators.relational import changed_files

    def batch(df: DataFrame, number: int) -> None:
        fresh = changed_files(df, known()).where("changed").select("path")
        sink(df.join(fresh, "path", "left_semi"), number)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
