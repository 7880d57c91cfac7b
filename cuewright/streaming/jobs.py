"""Structured Streaming: a queue of jobs without duplicates, sessions of events, and micro-batches that append to the ledger."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cuewright.functions.timecode import in_window, minute_of_day


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table as a stream; its times get a zone so that a watermark can follow them."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile():
        path, name = path.rsplit("/", 1)  # a stream watches a folder
        reader = reader.option("pathGlobFilter", name)
    rows = reader.parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, events): runs of a user's events closer than ``gap``; rows later than ``late`` are dropped by the watermark."""
    grouped = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("events")).select("user_id", "w.start", "w.end", "events")


def with_open_sessions(closed: DataFrame, events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """The closed sessions, and those of events (a batch) behind a user's last closed one, which the watermark has not reached."""
    last = closed.groupBy("user_id").agg(F.max("end").alias("closed_to"))
    rest = events.join(last, "user_id", "left").where(F.col("closed_to").isNull() | (F.col("ts") > F.col("closed_to")))
    open_ones = rest.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return closed.select("user_id", "start", "end", "events").union(open_ones.select("user_id", "w.start", "w.end", "events"))


def queue(jobs: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (path, source) once within the watermark."""
    return jobs.withWatermark("ts", late).dropDuplicatesWithinWatermark(["path", "source"])


def forced_queue(jobs: DataFrame, keep: str | None = None, late: str = "1 hour") -> DataFrame:
    """(path, force): a job when its path is first seen, and once more when a later request forces it.

    With ``keep`` requests have a time ``ts``, and a path that nobody asks for during ``keep`` is forgotten once the watermark
    (``late``) is past that, so that the state is bounded; when it comes back it is a new one. Requests behind the watermark
    are dropped. Without ``keep`` paths are remembered for ever.
    """
    keep_ms = None if keep is None else int(pd.Timedelta(keep).total_seconds() * 1000)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, forced = state.get if state.exists else (False, False)
        asked, latest = False, 0 if keep_ms is None else state.getCurrentWatermarkMs()
        for p in parts:
            asked |= bool(p["force"].any())
            if keep_ms is not None and p["ts"].notna().any():
                latest = max(latest, int(p["ts"].max().timestamp() * 1000))
        if not seen or (asked and not forced):
            yield pd.DataFrame({"path": [key[0]], "force": [asked]})
        state.update((True, forced or asked))
        if keep_ms is not None:
            state.setTimeoutTimestamp(latest + keep_ms)

    timeout = GroupStateTimeout.NoTimeout if keep is None else GroupStateTimeout.EventTimeTimeout
    timed = jobs if keep is None else jobs.withWatermark("ts", late)
    return timed.groupBy("path").applyInPandasWithState(run, "path string, force boolean", "seen boolean, forced boolean", "append", timeout)


def allowed_now(jobs: DataFrame, minute: int, start: str | None, end: str | None) -> DataFrame:
    """Jobs that may run at a minute of the day: those inside the work window, and those that bypass it."""
    if not start or not end:
        return jobs
    inside = in_window(F.lit(minute), minute_of_day(F.lit(start)), minute_of_day(F.lit(end)))
    return jobs.where(F.coalesce("bypass_window", F.lit(False)) | inside)


def run_jobs(jobs: DataFrame, work: Callable[[DataFrame], DataFrame], ledger_path: str, checkpoint: str) -> StreamingQuery:
    """Process micro-batches with ``work`` and append its ledger events. A batch that is tried again after a
    failure overwrites its own partition, so its events are written once."""

    def batch(rows: DataFrame, number: int) -> None:
        work(rows).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(ledger_path)

    return jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(query: StreamingQuery) -> dict[str, float]:
    """Rows so far and their rate, from the query's own figures."""
    seen = query.recentProgress
    return {"batches": len(seen), "rows": sum(p["numInputRows"] for p in seen), "rows_per_second": seen[-1]["processedRowsPerSecond"] if seen else 0.0}
