"""Streaming twins: the state of each job as its events arrive, and usage by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def job_states(events: DataFrame, key: str = "user_id", kind: str = "event_type", time: str = "ts", number: str = "event_id") -> DataFrame:
    """The last kind of each job, its attempts (errors) and when it may run again: complete-mode state, a row a job."""
    last = F.max(F.struct(time, number, kind)).alias("last")
    states = events.groupBy(key).agg(F.count_if(F.col(kind) == "error").alias("attempts"), last)
    backoff = F.least(F.lit(60), F.greatest(F.lit(1), 5 * F.col("attempts")))
    return states.select(
        key,
        F.col(f"last.{kind}").alias("state"),
        "attempts",
        (F.col(f"last.{time}") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), backoff.cast("decimal(18,6)"))).alias("next_run")
    )


def usage_windows(events: DataFrame, time: str = "ts", late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Events by kind and window, with a watermark, so that state ends with its window."""
    timed = events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything there is now, appended to Parquet files: exactly once, as the checkpoint and the sink's log decide."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_to_snapshots(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The whole state after each batch, a folder a batch below `path`; a batch that is run again replaces its folder."""
    write = lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    query = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Everything there is now, into an in-memory table on the driver: for looking at small results."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
