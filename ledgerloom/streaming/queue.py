"""A job queue as a stateful stream: claims, locks that grow stale, back-off and failure, in the order of event time.

Events (queue, number, at, kind, job) of a queue are held until the watermark has passed them and then taken in the order
of (at, number), with the locks that have grown stale by then, so what becomes of a job doesn't depend on how the stream was
cut into batches, nor on events that come late by less than the watermark's delay.  Kinds:

* `submit`: the job waits, from now on;
* `claim`: the job that has waited longest and may run is locked and counts one more attempt (SO9);
* `done`, `fail`: the job ends; without a job, the one that has been locked longest;
* anything else only moves the time on.

A lock older than STALE is taken off: the job fails with its third attempt, and otherwise waits again, for five seconds an
attempt, from one to sixty (SNK5, MA2, FLT6).  An event for a job in another state changes nothing.  A queue is worked on by
one task at a time; queues, which are as many as their numbers say, are what spreads the work.

Each call of the state is a message to the JVM, so events travel and are held packed, and a queue is settled at once up to
the watermark, by the first of its timers: calls go with the queues in a batch and with thousands of events or jobs.
A task holds what one queue has that isn't settled, its open jobs and what it says of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import MapState

#: Times are microseconds since 1970, so no time zone matters.
STALE, MAX_ATTEMPTS = 15 * 60_000_000, 3
STATUSES = ("queued", "running", "done", "failed")
TICK, SUBMIT, CLAIM, DONE, FAIL, DONE_JOB, FAIL_JOB = range(7)
#: Packed state: events; jobs, with the time at which one is due or was locked.
EVENT = np.dtype([("us", "i8"), ("number", "i8"), ("job", "i8"), ("kind", "i1")])
JOB = np.dtype([("job", "i8"), ("since", "i8"), ("when", "i8"), ("attempts", "i4"), ("locked", "i1")])
#: Records in one value of the state or one row, and events that a task packs at a time.
CHUNK, PACK = 1_000, 500_000
_CHANGE = "queue long, job array<long>, us array<long>, pos array<int>, status array<int>, attempts array<int>, due array<long>"
_JOB_STATE = "job long, us long, version long, attempts long, status string, backoff_s long"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session for streams with keyed state and timers, beside the given one, whose settings stay."""
    session = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(name, spark.conf.get(name))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    return session


def backoff_seconds(attempts: int) -> int:
    return min(60, max(1, 5 * attempts))


def _millis(us: int) -> int:
    """The first whole millisecond behind a time, as timers count them."""
    return us // 1000 + 1


class JobQueue(StatefulProcessor):
    """State of one queue: events that aren't settled, jobs that wait or run, and jobs that have ended, all of them packed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # in maps, as a list is read again for each value that it gets
        self.held = handle.getMapState("held", "batch long, part int", "records binary")
        self.open = handle.getMapState("open", "batch long, part int", "records binary")
        self.ended = handle.getMapState("ended", "upper long", "lower binary")
        self.seen: set[tuple] = set()  # queues that this task has settled up to its watermark

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        passed, first = timerValues.getCurrentWatermarkInMs(), []
        for part, r in enumerate(rows):
            events = np.frombuffer(r["events"], EVENT)
            events = events[_millis(events["us"]) > passed]
            if len(events):
                self.held.updateValue((timerValues.getCurrentProcessingTimeInMs(), part), (events.tobytes(),))
                first.append(int(events["us"][0]))
        if first:
            self.handle.registerTimer(_millis(min(first)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if key in self.seen:
            return iter(())
        self.seen.add(key)
        return self.settled(key[0], timerValues.getCurrentWatermarkInMs())

    def settled(self, queue: int, until: int) -> Iterator[Row]:
        """What happens up to a time, packed: held events and stale locks, in order."""
        held = _unpacked(self.held, EVENT)
        held = held[np.lexsort((held["number"], held["us"]))]
        again = (held["us"][1:] == held["us"][:-1]) & (held["number"][1:] == held["number"][:-1])
        held = held[np.append(~again, True)[: len(held)]]  # a repeated event is the same entry, as it came last
        passed = int(np.searchsorted(held["us"], 1000 * until))
        jobs = _unpacked(self.open, JOB).tolist()
        # job: (since, attempts, when it is due or was locked)
        waiting = {job: (since, attempts, when) for job, since, when, attempts, locked in jobs if not locked}
        running = {job: (since, attempts, when) for job, since, when, attempts, locked in jobs if locked}
        locks = [(when, job) for job, (_, _, when) in running.items()]  # those of jobs that have ended stay in it
        if not passed and not any(_millis(locked + STALE) <= until for locked, _ in locks):
            self.wake(held, locks)
            return
        later, ready = [(due, since, job) for job, (since, _, due) in waiting.items()], []
        for heap in (locks, later):
            heapq.heapify(heap)
        known, out, pos = None, [], 0  # known: whether jobs have ended before
        ended: dict[int, set[int]] = {}  # lower bits by upper ones, of those that matter here
        more: set[int] = set()  # upper bits of jobs that end now

        def oldest() -> int | None:
            """The job that has been locked longest."""
            while locks and (locks[0][1] not in running or running[locks[0][1]][2] != locks[0][0]):
                heapq.heappop(locks)
            return locks[0][1] if locks else None

        def over(upper: int) -> set[int]:
            nonlocal known
            if upper not in ended:
                known = self.ended.exists() if known is None else known
                stored = self.ended.getValue((upper,)) if known else None
                ended[upper] = set(np.frombuffer(stored[0], "u2").tolist() if stored else ())
            return ended[upper]

        def end(job: int) -> None:
            over(job >> 16).add(job & 0xFFFF)
            more.add(job >> 16)

        def say(at: int, job: int, status: str, attempts: int, due: int = 0) -> None:
            nonlocal pos
            out.append((job, at, pos, STATUSES.index(status), attempts, due))
            pos += 1

        def wait(job: int, since: int, attempts: int, due: int) -> None:
            waiting[job] = since, attempts, due
            heapq.heappush(later, (due, since, job))

        def recover(before: int | None) -> None:
            """Takes off locks that are older than STALE at a time, or at the end of what is settled."""
            while (job := oldest()) is not None:
                since, attempts, locked = running[job]
                at = locked + STALE
                if at >= before if before is not None else _millis(at) > until:
                    break
                del running[job]
                if attempts >= MAX_ATTEMPTS:
                    end(job)
                    say(at, job, "failed", attempts)
                else:
                    wait(job, since, attempts, at + 1_000_000 * backoff_seconds(attempts))
                    say(at, job, "queued", attempts, waiting[job][2])

        for start in range(0, passed, CHUNK):
            for at, _, job, kind in held[start : min(start + CHUNK, passed)].tolist():
                recover(at)
                if kind == SUBMIT:
                    if job not in waiting and job not in running and job & 0xFFFF not in over(job >> 16):
                        wait(job, at, 0, at)
                        say(at, job, "queued", 0, at)
                elif kind == CLAIM:
                    while later and later[0][0] <= at:
                        heapq.heappush(ready, heapq.heappop(later)[1:])
                    if ready:
                        since, job = heapq.heappop(ready)
                        attempts = waiting.pop(job)[1] + 1
                        running[job] = since, attempts, at
                        heapq.heappush(locks, (at, job))
                        say(at, job, "running", attempts)
                elif kind != TICK:
                    job = oldest() if kind in (DONE, FAIL) else job
                    if job in running:
                        attempts = running.pop(job)[1]
                        end(job)
                        say(at, job, "done" if kind in (DONE, DONE_JOB) else "failed", attempts)
            if len(out) >= CHUNK:
                yield _changes(queue, out)
                out.clear()
        recover(None)
        if out:
            yield _changes(queue, out)
        for upper in more:
            self.ended.updateValue((upper,), (np.array([*ended[upper]], "u2").tobytes(),))
        held = held[passed:]
        _pack(self.held, held)
        rows = [(job, since, when, attempts, locked) for locked, jobs in enumerate((waiting, running)) for job, (since, attempts, when) in jobs.items()]
        _pack(self.open, np.array(rows, JOB))
        self.wake(held, [(v[2], job) for job, v in running.items()])

    def wake(self, held: np.ndarray, locks: list[tuple[int, int]]) -> None:
        """A timer for what comes next; held events are in order."""
        times = [locked + STALE for locked, _ in locks]
        times += held["us"][:1].tolist()
        if times:
            self.handle.registerTimer(_millis(min(times)))


def _unpacked(state: MapState, kind: np.dtype) -> np.ndarray:
    """All records, those of older batches first."""
    parts = sorted((tuple(k), v[0]) for k, v in state.iterator())
    return np.concatenate([np.empty(0, kind), *[np.frombuffer(records, kind) for _, records in parts]])


def _pack(state: MapState, records: np.ndarray) -> None:
    """These records alone, older than those of any batch to come."""
    state.clear()
    for i in range(0, len(records), CHUNK):
        state.updateValue((0, i // CHUNK), (records[i : i + CHUNK].tobytes(),))


def _changes(queue: int, rows: list[tuple]) -> Row:
    job, us, pos, status, attempts, due = (np.array(c) for c in zip(*rows))
    return Row(queue=queue, job=job, us=us, pos=pos.astype("int32"), status=status.astype("int32"), attempts=attempts.astype("int32"), due=due)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events of a queue in order, as few rows as hold up to PACK events of all queues at a time; `at` is the newest one's."""

    def rows(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by([("queue", "ascending"), ("us", "ascending"), ("number", "ascending")])
        events = np.empty(len(table), EVENT)
        for name in EVENT.names:
            events[name] = table[name]
        queue = table["queue"].combine_chunks()
        own, none = queue.fill_null(0).to_numpy(), queue.is_null().to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(np.append((own[1:] != own[:-1]) | (none[1:] != none[:-1]), True)) + 1
        starts = [0, *ends[:-1].tolist()]
        cuts = [(i, min(i + CHUNK, end)) for start, end in zip(starts, ends.tolist()) for i in range(start, end, CHUNK)]
        last = pa.array([end - 1 for _, end in cuts])
        return pa.RecordBatch.from_arrays(
            [queue.take(last), table["at"].combine_chunks().take(last), pa.array([events[i:j].tobytes() for i, j in cuts], pa.binary())], names=["queue", "at", "events"]
        )

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= PACK:
            yield rows(held)
            held = []
    if sum(map(len, held)):
        yield rows(held)


def queue_changes(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(queue, job, at, pos, status, attempts, due), a row for each change of a job's state; events: (queue, number, at, kind, job).

    Changes of one job are in the order of (at, pos).  Those of the last `delay` come when later events have moved the
    watermark past them.  Events without a time have no place in the order and change nothing.
    """
    named = F.col("job").isNotNull()
    does = lambda kind: F.col("kind") == kind
    kind = F.when(does("submit") & named, SUBMIT).when(does("claim"), CLAIM).when(does("done"), F.when(named, DONE_JOB).otherwise(DONE))
    kind = kind.when(does("fail"), F.when(named, FAIL_JOB).otherwise(FAIL)).otherwise(TICK)
    number = F.coalesce(F.col("number").cast("long"), F.lit(-(2**63)))  # an event without a number is the first of its time
    timed = _timed(events.filter("at IS NOT NULL"), "queue", "number", "kind", "job")
    coded = timed.select(F.col("queue").cast("long").alias("queue"), "at", "us", number.alias("number"), F.coalesce(F.col("job").cast("long"), F.lit(0)).alias("job"), kind.alias("kind"))
    packed = coded.repartition("queue").mapInArrow(_packed, "queue long, at timestamp, events binary").withWatermark("at", delay)
    made = packed.groupBy("queue").transformWithState(JobQueue(), _CHANGE, "Append", "EventTime")
    each = made.select("queue", F.inline(F.arrays_zip("job", "us", "pos", "status", "attempts", "due")))
    status = F.element_at(F.array(*map(F.lit, STATUSES)), F.col("status") + 1)
    due = F.when(F.col("status") == STATUSES.index("queued"), F.timestamp_micros("due"))
    return each.select("queue", "job", F.timestamp_micros("us").alias("at"), "pos", status.alias("status"), "attempts", due.alias("due"))


def _timed(events: DataFrame, *columns: str) -> DataFrame:
    at = F.col("at").cast("timestamp")
    return events.select(*columns, at.alias("at"), F.unix_micros(at).alias("us"))


class JobStates(StatefulProcessor):
    """State of one job whose every event renews its lock: errors so far and the newest event; a row for each change."""

    def __init__(self, until: int | None):
        self.until = until

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "attempts long, last long, version long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        attempts, last, version = self.state.get() if self.state.exists() else (0, None, 0)
        before = last
        for r in rows:
            attempts += r["kind"] == "error"
            last = r["us"] if last is None else max(last, r["us"])
        if last != before:
            if before is not None:
                self.handle.deleteTimer(_millis(before + STALE))
            if self.until is None or last + STALE < self.until:
                self.handle.registerTimer(_millis(last + STALE))
        yield self.said(key, attempts, last, version + 1, "running")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        attempts, last, version = self.state.get()
        if _millis(last + STALE) <= expiredTimerInfo.getExpiryTimeInMs():
            yield self.said(key, attempts, last, version + 1, "failed" if attempts >= MAX_ATTEMPTS else "queued")

    def said(self, key, attempts: int, last: int, version: int, status: str) -> Row:
        self.state.update((attempts, last, version))
        return Row(job=key[0], us=last, version=version, attempts=attempts, status=status, backoff_s=backoff_seconds(attempts))


def job_state_changes(events: DataFrame, delay: str = "10 minutes", until: str | None = None) -> DataFrame:
    """(job, at, version, attempts, status, backoff_s), of which a job's newest version holds; events: (job, at, kind).

    Up to a time `until`: later events only move the watermark, and later timers aren't set.
    """
    timed, end = _timed(events, "job", "kind").withWatermark("at", delay), None
    if until is not None:
        limit = F.lit(until).cast("timestamp")
        end = events.sparkSession.range(1).select(F.unix_micros(limit)).first()[0]
        timed = timed.filter(F.col("at") <= limit)
    made = timed.groupBy("job").transformWithState(JobStates(end), _JOB_STATE, "Update", "EventTime")
    return made.select("job", F.timestamp_micros("us").alias("at"), "version", "attempts", "status", "backoff_s")
