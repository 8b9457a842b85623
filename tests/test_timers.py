"""Jobs with timers against simulations that go from instant to instant, with out-of-order batches."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lorekeep.plans import streams
from lorekeep.streaming import jobs, timers


def closes(rows, idle, least):
    """Of one key's (time, disposed): every millisecond that matters, in order."""
    out, total, told, alarm = [], 0, None, None
    times = sorted({t for t, _ in rows} | {t + idle for t, _ in rows})
    for now in times:
        here = [d for t, d in rows if t == now]
        if alarm == now and True not in here and False not in here:
            reason = "idle"
        elif alarm == now and False in here:  # activity at the instant of the alarm puts it off
            reason = None
        else:
            reason = None
        if False in here:
            total += here.count(False)
            alarm = now + idle
        for _ in range(here.count(True)):
            alarm = None
            if told is None or total - told >= least:
                out.append((now, "disposed", total))
                told = total
        if reason:
            alarm = None
            if told is None or total - told >= least:
                out.append((now, "idle", total))
                told = total
    return out


def builds(times, debounce, length):
    """Of one key's changes: a timer, a running build and a flag, from millisecond to millisecond."""
    out, scheduled, until, pending, folded = [], None, None, False, 0
    now, last = min(times), max(times)
    left = sorted(times)
    while left or scheduled is not None or until is not None:
        now = min([t for t in (left[0] if left else None, scheduled, until) if t is not None])
        while left and left[0] == now:
            left.pop(0)
            folded += 1
            scheduled = now + debounce if scheduled is None else scheduled
        if until == now:
            until = None
            if pending:
                pending = False
                scheduled = now + debounce if scheduled is None else min(scheduled, now + debounce)
        if scheduled == now:
            scheduled = None
            if until is not None:
                pending = True
            else:
                out.append((now, folded))
                until, folded = now + length, 0
    assert now >= last
    return out


@pytest.mark.parametrize("seed", range(40))
def test_walks_by_simulation(seed):
    rng = random.Random(seed)
    rows = sorted((rng.randrange(200), rng.random() < 0.2) for _ in range(rng.randint(1, 60)))
    start, step, due = timers.close_step(7, 3)
    assert timers.walk(start, [(t, int(d)) for t, d in rows], None, step, due, timers.Timed.ALARM)[1] == closes(rows, 7, 3)
    start, step, due = timers.rebuild_step(5, 11)
    state, got = timers.walk(start, [(t, 0) for t, _ in rows], None, step, due, timers.Timed.ALARM)
    assert [(t, n) for t, _, n in got] == builds([t for t, _ in rows], 5, 11) and sum(n for _, _, n in got) == len(rows)
    # in two goes, the second from where the first one ended
    cut = rng.randrange(200)
    state, first = timers.walk(start, [(t, 0) for t, _ in rows if t <= cut], cut, step, due, timers.Timed.ALARM)
    assert first + timers.walk(state, [(t, 0) for t, _ in rows if t > cut], None, step, due, timers.Timed.ALARM)[1] == got


def test_dispose_beats_the_alarm_once():
    start, step, due = timers.close_step(10, 1)
    run = lambda rows: timers.walk(start, rows, None, step, due, timers.Timed.ALARM)[1]
    assert run([(0, 0), (10, 1)]) == [(10, "disposed", 1)]
    assert run([(0, 0), (11, 1)]) == [(10, "idle", 1)]
    assert run([(0, 0), (10, 0), (12, 1), (13, 1)]) == [(12, "disposed", 2)]


@pytest.fixture
def batches(spark, tmp_path):
    """Rows of several users in files that are out of order of time."""
    rng = random.Random(7)
    rows = [(rng.choice([1, 2, None, 3]), rng.randrange(3_600_000), rng.choice(["view", "view", "view", "error"])) for _ in range(240)]
    for i in range(4):
        df = spark.createDataFrame(rows[i::4], "user_id long, ms long, event_type string")
        df.select("user_id", F.timestamp_millis("ms").alias("ts"), "event_type").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    return rows, str(tmp_path)


def finished(spark, path, job):
    closing = spark.createDataFrame([(None, 10**12, None)], "user_id long, ms long, event_type string").select("user_id", F.timestamp_millis("ms").alias("ts"), "event_type")
    out = timers.finished_and_closed(spark, lambda p: job(jobs.events_stream(spark, p, 1)), f"{path}/events.parquet", closing)
    return sorted(map(tuple, out.where("user_id is not null").collect()))


def test_closes_over_batches(spark, batches):
    rows, path = batches
    got = finished(spark, path, lambda e: timers.session_closes(e, "user_id", "event_type = 'error'", 60_000, 4, "2 hours"))
    assert got == sorted((u, *c) for u in (1, 2, 3) for c in closes([(m, e == "error") for v, m, e in rows if v == u], 60_000, 4))
    # a narrower watermark than the batches' disorder loses rows, but tells nothing twice
    some = finished(spark, path, lambda e: timers.session_closes(e, "user_id", "event_type = 'error'", 60_000, 4, "1 second"))
    assert len(some) == len(set(some))


def test_rebuilds_and_limits_over_batches(spark, batches):
    rows, path = batches
    got = finished(spark, path, lambda e: timers.rebuilds(e, "user_id", 20_000, 90_000, "2 hours"))
    assert [(u, t, n) for u, t, _, n in got] == sorted((u, *b) for u in (1, 2, 3) for b in builds([m for v, m, _ in rows if v == u], 20_000, 90_000))
    limited = finished(spark, path, lambda e: timers.rate_limited(e, "user_id", 3, 600_000, "2 hours"))
    want = []
    for u in (1, 2, 3):
        start, used = None, 0
        for t in sorted(m for v, m, _ in rows if v == u):
            if start is None or t - start >= 600_000:
                start, used = t, 0
            if used < 3:
                used += 1
                want.append((u, t))
    assert [(u, t) for u, t, _, _ in limited] == sorted(want)


def test_processing_time(spark, batches):
    _, path = batches
    stream = timers.rebuilds(jobs.events_stream(spark, f"{path}/events.parquet", 64), "user_id", 1, 1, None)
    query = stream.writeStream.format("memory").queryName("rebuilt").outputMode("append").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            if spark.table("rebuilt").count() >= 4:
                break
        told = spark.table("rebuilt").collect()
    finally:
        query.stop()
    assert sorted(r.n for r in told) == sorted([sum(v == u for v, _, _ in batches[0]) for u in (1, 2, 3, None)])


def test_registered(spark, sf_dir):
    events = [(r.user_id, r.ms, r.event_type) for r in spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id", "unix_millis(cast(ts as timestamp)) as ms", "event_type").collect()]
    users = {u for u, _, _ in events if u is not None}
    got = sorted(map(tuple, streams.stream_session_closes(spark, sf_dir).collect()))
    assert got == sorted((u, *c) for u in users for c in closes([(m, e == "error") for v, m, e in events if v == u], 12 * 3_600_000, 4))
    got = sorted(map(tuple, streams.stream_rebuilds(spark, sf_dir).collect()))
    assert got == sorted((u, *b) for u in users for b in builds([m for v, m, _ in events if v == u], 3_600_000, 6 * 3_600_000))


class Touched:
    """A handle whose states and timers live in memory; every touch is a message."""

    def __init__(self):
        self.messages, self.timers, self.states = 0, set(), []

    def state(self, *_):
        self.states.append(one := _Kept(self))
        return one

    getValueState = getListState = state  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.messages += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.messages += 1
        self.timers.remove(at)


class _Kept:
    def __init__(self, handle):
        self.handle, self.values, self.one = handle, [], None

    def __getattr__(self, name):
        def touch(*a):
            self.handle.messages += 1
            if name == "get":
                return self.one if not self.values else iter(self.values)
            if name == "update":
                self.one = a[0]
            elif name == "put":
                self.values = list(a[0])
            elif name == "appendValue":
                self.values.append(a[0])
            elif name == "clear":
                self.values = []

        return touch


def test_few_messages_a_key():
    """A batch of a key is one value of the state, whatever its rows, and each batch takes as many messages as the one before."""
    from types import SimpleNamespace

    rng = random.Random(3)
    handle, job = Touched(), timers.Timed(*timers.limit_step(2, 1000), "u", True, None)
    job.init(handle)
    before = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    rows, counts = [], []
    for _ in range(5):
        batch = [(7, None, rng.randrange(1, 100_000), 0) for _ in range(500)]
        rows += [r[2] for r in batch]
        handle.messages = 0
        assert list(job.handleInputRows((7,), iter(batch), before)) == []
        counts.append(handle.messages)
    assert max(counts) <= 5 and handle.timers == {min(rows)} and sum(len(s.values) for s in handle.states) == 5
    after = SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**6)
    handle.messages = 0
    told = list(job.handleExpiredTimer((7,), after, SimpleNamespace(getExpiryTimeInMs=lambda: min(rows))))
    want, start, used = [], None, 0
    for t in sorted(rows):
        if start is None or t - start >= 1000:
            start, used = t, 0
        if used < 2:
            used += 1
            want.append(t)
    assert [r.ms for r in told] == want and handle.messages <= 5 and not any(s.values for s in handle.states)
