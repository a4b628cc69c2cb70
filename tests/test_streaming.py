"""Stateful streams against plain Python, whatever the batches; upserts that may run twice."""

import os
import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import queue as Q
from ledgerloom.streaming import upserts as U

START = datetime(2024, 1, 1)
EVENT = "queue long, number long, at timestamp, kind string, job long"


def made_events(n=160):
    rng, at, out = random.Random(12), START, []
    for number in range(n):
        at += timedelta(seconds=rng.choice([0, 1, 7, 40, 200, 700]), microseconds=rng.randrange(3))
        kind = rng.choice(["submit", "submit", "claim", "claim", "claim", "done", "fail", "tick"])
        job = rng.randrange(40) if kind == "submit" or rng.random() < 0.3 and kind != "claim" else None
        out.append((rng.randrange(2), number, at, kind, job))
    return [*out, (0, n, at + timedelta(days=1), "tick", None), (1, n + 1, at + timedelta(days=1), "tick", None)]


def simulated(events):
    """(queue, job): (status, attempts), of all events a watermark has passed, by a clock that goes from event to event."""
    out = {}
    for queue in {e[0] for e in events}:
        jobs = {}

        def stale(now):
            for end, job in sorted((j["locked"] + timedelta(minutes=15), k) for k, j in jobs.items() if j["status"] == "running"):
                if end < now:
                    j = jobs[job]
                    j["status"] = "failed" if j["attempts"] >= 3 else "queued"
                    j["due"] = end + timedelta(seconds=min(60, max(1, 5 * j["attempts"])))

        for _, _, at, kind, job in sorted((e for e in events if e[0] == queue), key=lambda e: (e[2], e[1])):
            stale(at)
            running = [k for k, j in jobs.items() if j["status"] == "running"]
            if kind == "submit" and job not in jobs:
                jobs[job] = {"status": "queued", "attempts": 0, "since": at, "due": at}
            elif kind == "claim" and (due := [(j["since"], k) for k, j in jobs.items() if j["status"] == "queued" and j["due"] <= at]):
                j = jobs[min(due)[1]]
                j.update(status="running", attempts=j["attempts"] + 1, locked=at)
            elif kind in ("done", "fail") and running:
                job = min(running, key=lambda k: (jobs[k]["locked"], k)) if job is None else job
                if job in running:
                    jobs[job]["status"] = "done" if kind == "done" else "failed"
        out |= {(queue, k): (j["status"], j["attempts"]) for k, j in jobs.items()}
    return out


def replayed(spark, folder, rows, schema, parts):
    """A stream that takes the parts of the rows one after the other."""
    for k, part in enumerate(parts):
        path = f"{folder}/in/{k:03d}"
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.parquet(path)
        for name in os.listdir(path):
            if name.endswith(".parquet"):
                os.utime(f"{path}/{name}", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


@pytest.mark.parametrize("splits", [0, 5])
def test_queue_ends_alike_however_it_is_cut(spark, tmp_path, splits):
    rows, rng = made_events(), random.Random(splits)
    order = list(range(len(rows) - 2))
    if splits:  # late by less than the delay, and some events twice
        order.sort(key=lambda i: rows[i][2] + timedelta(seconds=rng.randrange(500)))
        order += rng.sample(order[-20:], 5)
    cuts = sorted(rng.sample(range(1, len(order)), splits))
    parts = [order[i:j] for i, j in zip([0, *cuts], [*cuts, len(order)])] + [[len(rows) - 2, len(rows) - 1]]
    session = Q.stateful_session(spark)
    changes = Q.queue_changes(replayed(session, tmp_path, rows, EVENT, parts))
    changes.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out").groupBy("queue", "job").agg(F.max(F.struct("at", "pos", "status", "attempts")).alias("s")).collect()
    expected = simulated(rows)
    assert {(r["queue"], r["job"]): (r["s"]["status"], r["s"]["attempts"]) for r in found} == expected
    assert {s for s, _ in expected.values()} == {"queued", "done", "failed"}


def queue_ends(spark, folder, rows, parts, within=600):
    changes = Q.queue_changes(replayed(Q.stateful_session(spark), folder, rows, EVENT, parts))
    query = changes.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    ended = query.awaitTermination(within)
    query.stop()
    assert ended, f"not done in {within} seconds"
    found = spark.read.schema(changes.schema).parquet(f"{folder}/out").groupBy("queue", "job").agg(F.max(F.struct("at", "pos", "status", "attempts")).alias("s")).collect()
    return {(r["queue"], r["job"]): (r["s"]["status"], r["s"]["attempts"]) for r in found}


@pytest.mark.parametrize("cuts", [[], [50, 110, 160]])
def test_stale_locks_end_without_a_later_event_of_their_queue(spark, tmp_path, cuts):
    rows = made_events()[:-2]
    rows += [(queue, 500 + 2 * queue + k, rows[-1][2] + timedelta(minutes=1 + k), kind, job) for queue in range(2) for k, (kind, job) in enumerate([("submit", 77), ("claim", None)])]
    ends = [(queue, 1000 + queue, rows[-1][2] + timedelta(days=1), "tick", None) for queue in range(3)]
    cuts = [0, *cuts, len(rows) + 1]
    parts = [list(range(i, j)) for i, j in zip(cuts, cuts[1:])]
    assert queue_ends(spark, tmp_path, [*rows, ends[2]], parts) == simulated([*rows, *ends[:2]])


def test_ten_thousand_events_of_a_queue_in_one_batch(spark, tmp_path):
    rows = [(7, number, at, kind, job) for _, number, at, kind, job in made_events(10_000)[:-1]]
    assert queue_ends(spark, tmp_path, rows, [list(range(len(rows)))], within=60) == simulated(rows)


def test_jobs_that_have_ended_are_known_in_later_batches(spark, tmp_path):
    jobs = [-70_000, -1, 0, 1, 65_535, 65_536, 2**40]
    steps = [*[("submit", j) for j in jobs], *[("claim", None)] * 7, *[("done", j) for j in jobs], *[("submit", j) for j in [*jobs, 2]]]
    rows = [(1, n, START + timedelta(seconds=60 * n), kind, job) for n, (kind, job) in enumerate(steps)]
    rows += [(1, 100, START + timedelta(days=1), "tick", None)]
    parts = [list(range(20)), [20], list(range(21, 29)), [29]]
    assert queue_ends(spark, tmp_path, rows, parts) == simulated(rows) == {(1, j): ("done", 1) for j in jobs} | {(1, 2): ("queued", 0)}


def test_events_are_packed_whole_and_in_order(monkeypatch):
    monkeypatch.setattr(Q, "PACK", 60)
    monkeypatch.setattr(Q, "CHUNK", 7)
    rng = random.Random(5)
    rows = [{"queue": rng.choice([None, 0, 1, 2]), "at": START + timedelta(seconds=s), "us": 10**6 * s, "number": n, "job": rng.randrange(9), "kind": rng.randrange(7)} for n in range(200) for s in [rng.randrange(50)]]
    schema = pa.schema([("queue", pa.int64()), ("at", pa.timestamp("us")), ("us", pa.int64()), ("number", pa.int64()), ("job", pa.int64()), ("kind", pa.int32())])
    found = []
    for batch in Q._packed(iter(pa.Table.from_pylist(rows, schema).to_batches(max_chunksize=20))):
        for r in batch.to_pylist():
            events = [dict(zip(Q.EVENT.names, e)) for e in np.frombuffer(r["events"], Q.EVENT).tolist()]
            assert 0 < len(events) <= 7 and events == sorted(events, key=lambda e: (e["us"], e["number"]))
            assert r["at"] == START + timedelta(microseconds=events[-1]["us"])
            found += [{"queue": r["queue"], **e} for e in events]
    by = lambda e: e["number"]
    assert sorted(found, key=by) == [{k: v for k, v in r.items() if k != "at"} for r in rows]


def test_a_batch_that_runs_twice_changes_nothing(spark, tmp_path):
    path, schema = f"{tmp_path}/table", spark.createDataFrame([], "k long, v long").schema
    frame = lambda rows: spark.createDataFrame(rows, "k long, v long")
    state = lambda: sorted(tuple(r) for r in U.snapshot(spark, path, schema).collect())
    merge = U.added("k", "v")
    assert state() == []
    U.upsert_batch(frame([(i, 1) for i in range(50)]), 0, path, schema, "k", merge, 8)
    files = lambda: {f"{d}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}
    before = files()
    touched = U.upsert_batch(frame([(3, 5), (3, 1), (99, 7)]), 1, path, schema, "k", merge, 8)
    once = state()
    assert once == sorted([(i, 7 if i == 3 else 1) for i in range(50)] + [(99, 7)]) and 0 < len(touched) <= 2
    assert before.items() <= files().items()
    U.upsert_batch(frame([(3, 5), (3, 1), (99, 7)]), 1, path, schema, "k", merge, 8)
    assert state() == once
    assert U.upsert_batch(frame([]), 2, path, schema, "k", merge, 8) == []
    assert U.vacuum(spark, path, schema) >= 1
    assert state() == once


def test_rows_replace_each_other_and_expiries_move_on(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, version long, v string").schema
    merge = U.replaced("k", ["version"])
    for batch, rows in enumerate([[("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], [("a", 2, "late"), ("c", 1, None), ("b", 9, "new")]]):
        U.upsert_batch(spark.createDataFrame(rows, schema), batch, f"{tmp_path}/t", schema, "k", merge, 4)
    assert sorted(tuple(r) for r in U.snapshot(spark, f"{tmp_path}/t", schema).collect()) == [("a", 3, "z"), ("b", 9, "new"), ("c", 1, None)]
    schema = spark.createDataFrame([], "k string, until timestamp_ntz").schema
    day = lambda n: datetime(2024, 1, n)
    merge = U.extended("k", "until", "at", "days")
    for batch, rows in enumerate([[("a", day(3), 2), ("a", day(1), 1), ("b", day(1), 30)], [("a", day(9), 1), ("b", day(2), 1)]]):
        U.upsert_batch(spark.createDataFrame(rows, "k string, at timestamp_ntz, days int"), batch, f"{tmp_path}/e", schema, "k", merge, 4)
    assert sorted(tuple(r) for r in U.snapshot(spark, f"{tmp_path}/e", schema).collect()) == [("a", day(10)), ("b", day(1) + timedelta(days=31))]


def test_reservations_meet_late_and_repeated_refunds(spark, tmp_path):
    rng, schema = random.Random(2), "job long, number long, at timestamp, quantity long"
    rows = [(rng.randrange(6), n, START + timedelta(minutes=20 * n), rng.randrange(9)) for n in range(120)]
    kinds = [rng.random() < 0.5 for _ in rows]
    end = [(-1, 1000 + k, START + timedelta(days=9), 0) for k in range(2)]
    streams = []
    for which in (False, True):
        own = [r for r, k in zip(rows, kinds) if k == which]
        order = sorted(range(len(own)), key=lambda i: own[i][2] + timedelta(minutes=rng.randrange(50)))
        own, order = [*own, end[which], (-1, 2000 + which, START + timedelta(days=20), 0)], [*order, order[-1]]
        parts = [order[:20], order[20:], [len(own) - 2], [len(own) - 1]]
        os.makedirs(f"{tmp_path}/{which}")
        streams.append(replayed(spark, f"{tmp_path}/{which}", own, schema, parts))
    met = U.settled_reservations(*streams)
    met.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    found = sorted((r["number"], r["refund"] or -1) for r in spark.read.parquet(f"{tmp_path}/out").filter("job >= 0").collect())
    reserves, refunds = ([r for r, k in zip(rows, kinds) if k == which] for which in (False, True))
    expected = []
    for job, number, at, _ in reserves:
        expected += sorted((number, n) for j, n, t, _ in refunds if j == job and at <= t <= at + timedelta(days=1)) or [(number, -1)]
    assert found == sorted(expected)
    batch = U.settled_reservations(spark.createDataFrame(reserves * 2, schema), spark.createDataFrame(refunds, schema))
    assert sorted((r["number"], r["refund"] or -1) for r in batch.collect()) == sorted(expected)
