"""Queries of the reporting family: threads, quotas, ledgers, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import relational as R
from ledgerloom.plans.registry import query, table

AS_OF = "2024-01-20 12:00:00"


def _cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


@query("""SELECT t.conv_id, count(m.turn) AS n, max(m.turn) AS latest FROM (SELECT DISTINCT conv_id FROM conversations) t
LEFT JOIN conversations m ON m.conv_id = t.conv_id AND m.role <> 'system' GROUP BY t.conv_id""")
def thread_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads with their visible messages counted, latest first (JN7, AG4, SO2)."""
    messages = table(spark, sf_dir, "conversations")
    return R.matched_counts(messages, messages, "conv_id", "turn", F.col("role") != "system").orderBy(F.desc_nulls_last("latest"), "conv_id")


@query("SELECT conv_id, turn, role, text FROM conversations WHERE (false OR role <> 'system')")
def thread_messages_visible(spark: SparkSession, sf_dir: str, show_internal: bool = False) -> DataFrame:
    """Messages in order, internal ones only on demand (FLT4, SO1)."""
    return table(spark, sf_dir, "conversations").filter(F.lit(show_internal) | (F.col("role") != "system")).orderBy("conv_id", "turn")


@query("SELECT conv_id, turn, role FROM conversations WHERE role = 'user' AND turn >= 1 AND turn <= 6 ORDER BY conv_id, turn LIMIT 20 OFFSET 20")
def thread_page_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of optionally filtered messages (FLT7, SO4)."""
    rows = R.filtered(table(spark, sf_dir, "conversations"), {"role": "user", "conv_id": None}).filter(F.col("turn").between(1, 6))
    return R.page(rows, [F.col("conv_id"), F.col("turn")], 2, 20).select("conv_id", "turn", "role")


@query("""SELECT user_id, greatest(coalesce(sum(CASE WHEN event_type = 'purchase' THEN q WHEN event_type = 'error' THEN -q ELSE 0 END), 0), 0)::BIGINT AS used
FROM (SELECT user_id, event_type, round(value * 100)::BIGINT AS q FROM events) GROUP BY user_id""")
def quota_used_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reservations less refunds of each user, never below 0 (AG1, MA1)."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(R.signed_sum(F.col("event_type"), _cents("value"), "purchase", "error").alias("used"))


@query("""WITH l AS (SELECT user_id, sum(round(value * 100)::BIGINT)::BIGINT AS used FROM events WHERE event_type = 'purchase' AND value > 100 GROUP BY user_id),
e AS (SELECT user_id, sum(round(value * 100)::BIGINT)::BIGINT AS used FROM events GROUP BY user_id)
SELECT coalesce(l.user_id, e.user_id) AS user_id, CASE WHEN l.user_id IS NOT NULL THEN l.used ELSE e.used END AS used, CASE WHEN l.user_id IS NOT NULL THEN 'first' ELSE 'second' END AS used_source
FROM l FULL JOIN e ON l.user_id = e.user_id""")
def quota_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's sum where a user has ledger rows, else the events' (AG2)."""
    events = table(spark, sf_dir, "events")
    total = lambda df: df.groupBy("user_id").agg(F.sum(_cents("value")).alias("used"))
    ledger = total(events.filter((F.col("event_type") == "purchase") & (F.col("value") > 100)))
    return R.with_fallback(
        ledger.withColumnRenamed("used", "total"),
        total(events).withColumnRenamed("used", "total"),
        "user_id",
        "total"
    ).select("user_id", F.col("total").alias("used"), F.col("used").alias("used_source"))


@query("""SELECT user_id, date_trunc('month', ts)::DATE::VARCHAR AS period_start, (date_trunc('month', ts) + INTERVAL 1 MONTH)::DATE::VARCHAR AS period_end, count(*) AS n,
sum(round(value * 100)::BIGINT)::BIGINT AS quantity FROM events GROUP BY ALL""")
def usage_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage by user and calendar month, with the month's bounds (DT2)."""
    start = F.trunc(F.col("ts").cast("date"), "month")
    rows = table(spark, sf_dir, "events").select(
        "user_id",
        start.cast("string").alias("period_start"),
        F.add_months(start, 1).cast("string").alias("period_end"),
        _cents("value").alias("q")
    )
    return rows.groupBy("user_id", "period_start", "period_end").agg(F.count("*").alias("n"), F.sum("q").alias("quantity"))


@query(
    """SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'date' WHEN c_acctbal > 0 THEN 'count' WHEN coalesce(c_nationkey, -1) % 2 = 0 THEN 'preview' ELSE 'none' END AS plan FROM customer"""
)
def plan_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered plan labels: by date, then by count, then preview (PRJ4, CN1)."""
    label = F.when(F.col("c_acctbal") > 5000, "date").when(F.col("c_acctbal") > 0, "count").when(F.coalesce("c_nationkey", F.lit(-1)) % 2 == 0, "preview").otherwise("none")
    return table(spark, sf_dir, "customer").select("c_custkey", label.alias("plan"))


@query("SELECT o_orderkey, c_name, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def ledger_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 newest ledger rows with their users; the top is taken before the join (JN3, SO2)."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("o_orderkey", "c_name", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(200)


@query("""SELECT o_orderkey, p_type, count(*) AS codes, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
GROUP BY o_orderkey, p_type""")
def code_batch_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes by batch and package: a three-way join (JN5, JN4)."""
    codes = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    joined = codes.join(
        table(spark, sf_dir, "part").select("p_partkey", "p_type"),
        F.col("l_partkey") == F.col("p_partkey")
    ).join(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderkey", "p_type").agg(F.count("*").alias("codes"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))


@query(
    """SELECT c_custkey, count(o_orderkey) AS n, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 150000 GROUP BY c_custkey"""
)
def left_join_on_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join whose condition on the right side stands in ON and so keeps unmatched rows (JN6)."""
    on = (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 150000)
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders"), on, "left")
    return joined.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.max("o_totalprice").alias("top"))


@query(
    """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1"""
)
def latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest order of each customer (WN8, SO3)."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return R.best_per_group(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query(
    """SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 2"""
)
def previous_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order before the newest of each customer (FLT5, WN9)."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return R.nth_per_group(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 2)


@query("""SELECT o_orderpriority, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS r FROM orders
WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1997-01-01') WHERE r = 1""")
def claim_next_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest waiting job that is due, for each queue (SO9, FLT6)."""
    due = table(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") <= F.lit("1997-01-01").cast("timestamp_ntz")))
    return R.best_per_group(due.select("o_orderpriority", "o_orderkey", "o_orderdate"), ["o_orderpriority"], ["o_orderdate", "o_orderkey"], largest=False)


@query(f"""SELECT user_id, attempts, CASE WHEN attempts >= 3 AND stale THEN 'failed' WHEN stale THEN 'queued' ELSE 'running' END AS status, least(60, greatest(1, attempts * 5)) AS backoff_s
FROM (SELECT user_id, count(*) FILTER (event_type = 'error') AS attempts, max(ts) < TIMESTAMP '{AS_OF}' - INTERVAL 15 MINUTE AS stale FROM events WHERE ts <= TIMESTAMP '{AS_OF}' GROUP BY user_id)""")
def stale_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose lock is older than 15 minutes wait again or, after three attempts, fail (SNK5, FLT6, MA2)."""
    now = F.lit(AS_OF).cast("timestamp_ntz")
    jobs = table(spark, sf_dir, "events").filter(F.col("ts") <= now).groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "error").alias("attempts"),
        (F.max("ts") < now - F.expr("INTERVAL 15 MINUTES")).alias("stale")
    )
    status = F.when((F.col("attempts") >= 3) & F.col("stale"), "failed").when(F.col("stale"), "queued").otherwise("running")
    return jobs.select("user_id", "attempts", status.alias("status"), F.least(F.lit(60), F.greatest(F.lit(1), F.col("attempts") * 5)).cast("long").alias("backoff_s"))


@query("""WITH d AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT coalesce(d.k, c.c_custkey) AS k, coalesce(d.v, c.c_acctbal) AS v
FROM (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') c FULL JOIN d ON d.k = c.c_custkey""")
def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after an insert that replaces on conflict (SNK2)."""
    base = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    delta = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return R.upserted(base, delta, "k")


@query(
    """SELECT k, sum(v)::BIGINT AS v FROM (SELECT c_custkey AS k, round(c_acctbal * 100)::BIGINT AS v FROM customer UNION ALL SELECT o_custkey, round(o_totalprice * 100)::BIGINT FROM orders WHERE o_orderstatus = 'P') GROUP BY k"""
)
def additive_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances after additive upserts (SNK3)."""
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), _cents("c_acctbal").alias("v"))
    return R.added(base, table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"), _cents("o_totalprice").alias("v")), "k", "v")


@query(
    f"""SELECT o_orderkey, greatest(coalesce(CASE WHEN o_orderstatus <> 'F' THEN o_orderdate END, TIMESTAMP '{AS_OF}'), TIMESTAMP '{AS_OF}') + to_days((o_orderkey % 30)::INT) AS valid_until FROM orders"""
)
def extended_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entitlements extended by days from their expiry or from now (SNK4, DT1)."""
    until = F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        R.extended(until, F.lit(AS_OF).cast("timestamp_ntz"), (F.col("o_orderkey") % 30).cast("int")).alias("valid_until")
    )


@query("""SELECT c_custkey, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_name END, c_mktsegment) AS c_mktsegment, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN 0.0 END, c_acctbal) AS c_acctbal
FROM customer LEFT JOIN nation ON n_nationkey = c_custkey""")
def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows patched with those values that aren't null (SNK6)."""
    nation = table(spark, sf_dir, "nation")
    patches = nation.select(
        F.col("n_nationkey").cast("long").alias("c_custkey"),
        F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("c_mktsegment"),
        F.when(F.col("n_nationkey") % 3 == 0, F.lit(0.0)).alias("c_acctbal")
    )
    return R.patched(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), patches, "c_custkey")


@query("""SELECT u.user_id, CASE WHEN c.c_custkey IS NOT NULL THEN round(c_acctbal * 100)::BIGINT ELSE 0 END AS balance, CASE WHEN c.c_custkey IS NOT NULL THEN c_mktsegment ELSE 'preview' END AS plan
FROM (SELECT DISTINCT user_id * 20 AS user_id FROM events) u LEFT JOIN customer c ON c.c_custkey = u.user_id""")
def get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each wanted key, with defaults where there was none (Z19)."""
    existing = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), _cents("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("plan"))
    return R.got_or_created(
        table(spark, sf_dir, "events").select((F.col("user_id") * 20).alias("user_id")),
        existing,
        "user_id",
        {"balance": F.lit(0).cast("long"), "plan": F.lit("preview")}
    )


@query("""SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM orders) AS jobs, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_jobs,
(SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS running_jobs, (SELECT count(DISTINCT conv_id) FROM conversations) AS threads, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors""")
def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar counts of several tables, one row each before they meet (AG5, FLT9; counts don't saturate)."""
    orders = table(spark, sf_dir, "orders").agg(
        F.count("*").alias("jobs"),
        F.count_if(F.col("o_orderstatus") == "O").alias("open_jobs"),
        F.count_if(F.col("o_orderstatus") == "P").alias("running_jobs")
    )
    users = table(spark, sf_dir, "customer").agg(F.count("*").alias("users"))
    threads = table(spark, sf_dir, "conversations").agg(F.count_distinct("conv_id").alias("threads"))
    errors = table(spark, sf_dir, "events").agg(F.count_if(F.col("event_type") == "error").alias("errors"))
    one = lambda df: df.withColumn("__k", F.lit(1))
    return one(users).join(one(orders), "__k").join(one(threads), "__k").join(one(errors), "__k").drop("__k")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that should be unique and aren't."""
    return R.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def orphan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without their counterpart (JN10)."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query(
    "SELECT event_id, floor(epoch(ts))::BIGINT AS epoch_s, ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AS in_range, event_id::VARCHAR AS id FROM events"
)
def epoch_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole epoch seconds, a half-open range and an id as text (PRJ1, PRJ2, DT3)."""
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("epoch_s"),
        ((F.col("ts") >= ts("2024-01-10")) & (F.col("ts") < ts("2024-01-20"))).alias("in_range"),
        F.col("event_id").cast("string").alias("id")
    )


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, coalesce((props->>'$.v2')::BIGINT, (props->>'$.k')::BIGINT * 10) AS v FROM events")
def json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON fields, the newer form first and the older as fallback (JS1, JS3)."""
    props = F.from_json("props", "k long, v2 long")
    return table(spark, sf_dir, "events").select("event_id", props["k"].alias("k"), F.coalesce(props["v2"], props["k"] * 10).alias("v"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_custkey = 7")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one key in some states; both filters reach the scan (SRC1, FLT1, FLT3)."""
    return table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("O", "P") & (F.col("o_custkey") == 7)).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def recent_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 newest rows (SRC2, SO2, SO10)."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(200)


@query("""SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE (CASE WHEN o_orderstatus <> 'F' THEN o_orderdate END IS NULL OR o_orderdate > TIMESTAMP '1996-01-01')
AND c_acctbal > 0""")
def valid_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens without an expiry or with a later one, of users in good standing (JN1, FLT2)."""
    expires = F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate"))
    valid = expires.isNull() | (F.col("o_orderdate") > F.lit("1996-01-01").cast("timestamp_ntz"))
    users = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey", "c_name")
    return table(spark, sf_dir, "orders").filter(valid).join(users, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", "c_name")


@query(
    """SELECT o_orderkey, CASE WHEN r = 1 THEN 'F' ELSE o_orderstatus END AS status, r = 1 AS returned FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)"""
)
def token_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot after each user's newest token was looked up, which revokes it (JN2, JN8, Z14)."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    newest = R.best_per_group(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.lit(True).alias("hit"))
    met = orders.join(newest, "o_orderkey", "left")
    return met.select("o_orderkey", F.when(F.col("hit"), "F").otherwise(F.col("o_orderstatus")).alias("status"), F.coalesce("hit", F.lit(False)).alias("returned"))


@query("""SELECT o_orderkey, n_orders, strategy FROM (SELECT o.o_orderkey, count(*) OVER () AS n_orders, CASE WHEN c.c_custkey IS NOT NULL THEN c.c_mktsegment || ':' || c.c_nationkey END AS strategy
FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal > 9000)""")
def optional_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested object that stands only where its row was joined, and a total beside each row (PRJ3)."""
    orders, users = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").filter("c_acctbal > 9000")
    met = orders.join(users, F.col("o_custkey") == F.col("c_custkey"), "left")
    nested = met.select(
        "o_orderkey",
        F.when(F.col("c_custkey").isNotNull(), F.struct(F.col("c_mktsegment").alias("type"), F.col("c_nationkey").alias("level"))).alias("strategy"),
        F.lit(1).alias("__k")
    )
    total = orders.agg(F.count("*").alias("n_orders")).withColumn("__k", F.lit(1))
    return nested.join(F.broadcast(total), "__k").select(
        "o_orderkey",
        "n_orders",
        F.concat_ws(":", "strategy.type", "strategy.level").alias("s"),
        "strategy"
    ).select("o_orderkey", "n_orders", F.when(F.col("strategy").isNotNull(), F.col("s")).alias("strategy"))


@query("SELECT event_type, count(*) AS n, max(ts) AS latest FROM events GROUP BY event_type")
def count_and_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and latest time of each kind (AG3)."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("latest"))
