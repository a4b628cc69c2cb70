"""Upserts of a stream into snapshots, exactly once: a batch that is run again leaves what it left before.

A snapshot is a Parquet folder of buckets of keys, each with versions named by the batch that wrote them; a bucket's newest
version holds.  A batch reads the versions before its own of those buckets that its keys fall into, and writes them anew;
others keep their files.  So a batch is repeatable, and its work follows what it touches, not what the snapshot holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

#: Makes the new rows of some keys from the old ones and a batch's.
Merge = Callable[[DataFrame, DataFrame], DataFrame]


def replaced(key: str, order: list[str]) -> Merge:
    """On conflict, the row with the largest `order` holds (SNK2)."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        rest = [c for c in old.columns if c != key and c not in order]
        best = old.unionByName(new).groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("__row"))
        return best.select(key, "__row.*").select(*old.columns)

    return merge


def added(key: str, *values: str) -> Merge:
    """On conflict, values are added to those there (SNK3)."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.unionByName(new.select(*old.columns)).groupBy(key).agg(*[F.sum(v).alias(v) for v in values]).select(*old.columns)

    return merge


def extended(key: str, until: str, at: str, days: str) -> Merge:
    """On conflict, the expiry moves on by days, from where it stands or from the time of the extension if that is later (SNK4).

    Extensions (key, at, days) of one batch are taken in the order of their times.
    """

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        steps = new.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(at, days))).alias("__steps"))
        both = old.join(steps, key, "full")
        longer = lambda end, s: F.greatest(F.coalesce(end, s[at]), s[at]) + F.make_dt_interval(s[days].cast("int"))
        end = F.aggregate(F.coalesce("__steps", F.array().cast(steps.schema["__steps"].dataType)), F.col(until), longer)
        return both.select(key, end.alias(until)).select(*old.columns)

    return merge


def _versions(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All versions of all buckets; empty where nothing has been written."""
    full = StructType([*schema.fields]).add("snapshot_bucket", "integer").add("snapshot_version", "long")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(path)


def _newest(rows: DataFrame) -> DataFrame:
    """Of each bucket, the rows of the newest version."""
    newest = rows.groupBy("snapshot_bucket").agg(F.max("snapshot_version").alias("snapshot_version"))  # from the folders' names: one row a bucket
    return rows.join(F.broadcast(newest), ["snapshot_bucket", "snapshot_version"])


def snapshot(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows that hold."""
    return _newest(_versions(spark, path, schema)).select(*schema.names)


def upsert_batch(new: DataFrame, batch: int, path: str, schema: StructType, key: str, merge: Merge, buckets: int) -> list[int]:
    """Merges one batch into the snapshot; returns the buckets it has written, `buckets` at most."""
    spark = new.sparkSession
    bucket: Column = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    new = new.persist()  # read for its buckets and for its rows
    try:
        touched = sorted(r[0] for r in new.select(bucket.alias("snapshot_bucket")).distinct().collect())
        if touched:
            before = _versions(spark, path, schema).filter(F.col("snapshot_bucket").isin(touched) & (F.col("snapshot_version") < batch))
            merged = merge(_newest(before).select(*schema.names), new)
            rows = merged.withColumns({"snapshot_bucket": bucket, "snapshot_version": F.lit(batch).cast("long")}).repartition("snapshot_bucket")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_bucket", "snapshot_version").parquet(path)
    finally:
        new.unpersist()
    return touched


def run_upserts(stream: DataFrame, path: str, checkpoint: str, schema: StructType, key: str, merge: Merge, buckets: int = 16, mode: str = "append") -> StreamingQuery:
    """Everything there is now, merged into the snapshot below `path`."""
    write = lambda df, batch: upsert_batch(df, batch, path, schema, key, merge, buckets)
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def vacuum(spark: SparkSession, path: str, schema: StructType) -> int:
    """Deletes the versions that don't hold any more; how many."""
    rows = _versions(spark, path, schema)
    newest = rows.groupBy("snapshot_bucket").agg(F.max("snapshot_version").alias("newest"))
    old = rows.select("snapshot_bucket", "snapshot_version").distinct().join(newest, "snapshot_bucket").filter("snapshot_version < newest").collect()
    for r in old:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/snapshot_bucket={r['snapshot_bucket']}/snapshot_version={r['snapshot_version']}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(old)


def settled_reservations(reserves: DataFrame, refunds: DataFrame, within: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(job, number, at, quantity, refund): each reservation with each refund of its job that followed within a time, or null (AG1, AG2).

    reserves and refunds: (job, number, at, quantity), streams or tables.  Repeated numbers count once; state ends `within`
    and `late` behind the newest events, when a reservation without a refund is said to have none.
    """
    streams = reserves.isStreaming
    once = lambda df: df.withWatermark("at", late).dropDuplicatesWithinWatermark(["number"]) if streams else df.dropDuplicates(["number"])
    left = once(reserves.withColumn("at", F.col("at").cast("timestamp")))
    right = once(refunds.select(F.col("job").alias("__job"), "number", F.col("at").cast("timestamp").alias("at")))
    right = right.select("__job", F.col("number").alias("__number"), F.col("at").alias("__at"))
    on = (F.col("job") == F.col("__job")) & (F.col("__at") >= F.col("at")) & (F.col("__at") <= F.col("at") + F.expr(f"INTERVAL {within}"))
    met = left.join(right, on, "leftOuter")
    return met.select("job", "number", "at", "quantity", F.col("__number").alias("refund"))
