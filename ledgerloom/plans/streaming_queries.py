"""Queries that replay tables as streams and read what the streams leave; each run has folders of its own in the shared one."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.plans.registry import query, table
from ledgerloom.plans.relational_queries import AS_OF
from ledgerloom.streaming import jobs, upserts
from ledgerloom.streaming import queue as Q


def _folder(spark: SparkSession, what: str) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='ledgerloom-')}"
    return f"{shared.rstrip('/')}/ledgerloom/{what}-{uuid.uuid4().hex}"


def _stream(session: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = session.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return session.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern may name a file or a folder


@query(f"""SELECT user_id AS job, attempts, CASE WHEN attempts >= 3 AND stale THEN 'failed' WHEN stale THEN 'queued' ELSE 'running' END AS status, least(60, greatest(1, attempts * 5)) AS backoff_s
FROM (SELECT user_id, count(*) FILTER (event_type = 'error') AS attempts, max(ts) < TIMESTAMP '{AS_OF}' - INTERVAL 15 MINUTE AS stale FROM events WHERE ts <= TIMESTAMP '{AS_OF}' GROUP BY user_id)""")
def streamed_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job states by timers of a stream, upserted into a snapshot (SNK2, SNK5, FLT6, MA2)."""
    session, path = Q.stateful_session(spark), _folder(spark, "recovery")
    events = _stream(session, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("ts").alias("at"), F.col("event_type").alias("kind"))
    changes = Q.job_state_changes(events, until=AS_OF)
    upserts.run_upserts(changes, f"{path}/table", f"{path}/checkpoint", changes.schema, "job", upserts.replaced("job", ["version"]), mode="update")
    return upserts.snapshot(spark, f"{path}/table", changes.schema).select("job", "attempts", "status", "backoff_s")


@query()
def streamed_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many jobs of each queue have come to each state, and with how many attempts: signups submit, views claim, purchases end, errors fail (SO9, WN9, SNK5, MA2)."""
    session, path = Q.stateful_session(spark), _folder(spark, "queue")
    kind = F.col("event_type")
    named = F.when(kind == "signup", "submit").when(kind == "view", "claim").when(kind == "purchase", "done").when(kind == "error", "fail").otherwise("tick")
    job = F.when(kind == "signup", F.col("event_id"))
    events = _stream(session, sf_dir, "events").select(
        F.col("user_id").alias("queue"), F.col("event_id").alias("number"), F.col("ts").alias("at"), named.alias("kind"), job.alias("job")
    )
    changes = Q.queue_changes(events)
    jobs.run_to_files(changes, f"{path}/changes", f"{path}/checkpoint")
    last = spark.read.schema(changes.schema).parquet(f"{path}/changes").groupBy("queue", "job").agg(F.max(F.struct("at", "pos", "status", "attempts")).alias("s"))
    return last.groupBy("queue", "s.status", "s.attempts").agg(F.count("*").alias("n"))


@query("""SELECT k, sum(v)::BIGINT AS v FROM (SELECT o_custkey AS k, round(o_totalprice * 100)::BIGINT AS v FROM orders UNION ALL SELECT user_id, round(value * 100)::BIGINT FROM events WHERE value IS NOT NULL) GROUP BY k""")
def streamed_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances added up by two streams, one after the other, in one snapshot (SNK3)."""
    path, schema = _folder(spark, "balances"), StructType().add("k", "long").add("v", "long")
    cents = lambda c: F.round(F.col(c) * 100).cast("long").alias("v")
    orders = _stream(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("k"), cents("o_totalprice"))
    events = _stream(spark, sf_dir, "events").filter("value IS NOT NULL").select(F.col("user_id").alias("k"), cents("value"))
    upserts.run_upserts(orders, f"{path}/table", f"{path}/c1", schema, "k", upserts.added("k", "v"))
    later = 1_000_000  # batches of the second stream are numbered behind those of the first
    write = lambda df, batch: upserts.upsert_batch(df, later + batch, f"{path}/table", schema, "k", upserts.added("k", "v"), 16)
    events.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/c2").trigger(availableNow=True).start().awaitTermination()
    return upserts.snapshot(spark, f"{path}/table", schema)


@query("""WITH p AS (SELECT user_id, event_id, ts, round(value * 100)::BIGINT AS q FROM events WHERE event_type = 'purchase'), e AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'error'),
m AS (SELECT p.user_id, p.event_id, any_value(q) AS q, count(e.event_id) AS refunds FROM p LEFT JOIN e ON e.user_id = p.user_id AND e.ts >= p.ts AND e.ts <= p.ts + INTERVAL 6 HOUR GROUP BY ALL)
SELECT user_id, count(*) AS reservations, count(*) FILTER (refunds > 0) AS refunded, coalesce(sum(q) FILTER (refunds = 0), 0)::BIGINT AS used FROM m GROUP BY user_id""")
def streamed_reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reservations without a refund within six hours, by a join of two streams whose state ends (AG1, AG2)."""
    path = _folder(spark, "reservations")
    rows = lambda kind: _stream(spark, sf_dir, "events").select(
        F.col("user_id").alias("job"), F.col("event_id").alias("number"), F.col("ts").alias("at"), F.round(F.col("value") * 100).cast("long").alias("quantity"), "event_type"
    ).filter(F.col("event_type") == kind).drop("event_type")
    met = upserts.settled_reservations(rows("purchase"), rows("error"), "6 HOURS")
    jobs.run_to_files(met, f"{path}/met", f"{path}/checkpoint")
    settled = spark.read.schema(met.schema).parquet(f"{path}/met")
    # what the watermarks haven't reached yet has no row: it is settled here as at the end of time
    all_rows = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("job"), F.col("event_id").alias("number"), F.round(F.col("value") * 100).cast("long").alias("quantity"))
    refunds = settled.groupBy("number").agg(F.count("refund").alias("refunds"))
    each = all_rows.join(refunds, "number", "left").withColumn("refunded", F.coalesce(F.col("refunds") > 0, F.lit(False)))
    used = F.coalesce(F.sum(F.when(~F.col("refunded"), F.col("quantity"))), F.lit(0)).cast("long").alias("used")
    return each.groupBy(F.col("job").alias("user_id")).agg(F.count("*").alias("reservations"), F.count_if("refunded").alias("refunded"), used)
