"""Stateful jobs with timers: sessions that close on silence or at once on a dispose event, and bursts of changes folded into rebuilds.

Rows are judged in order of event time, whatever batch brings them: they wait in the state until the watermark has passed them, and one
timer a key, at the earliest time at which anything can happen, wakes it. So results don't depend on how the input is split,
state holds what the watermark hasn't passed and a few numbers a key, and every result is told once. A key's walk is a small function
over times in order (:func:`close_step`, :func:`rebuild_step`); with processing time the same walk runs on arrival times.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.ordered import scratch_folder

#: What the engine needs for timers and state of many kinds.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Numbers = tuple[int, ...]
Step = Callable[[Numbers, int, int], tuple[Numbers, list[tuple[int, str, int]]]]


def close_step(idle_ms: int, least: int) -> tuple[Numbers, Step, Callable[[Numbers], int]]:
    """(start, step, due) of sessions: ``last`` activity (-1: none waits), ``total`` messages, ``told`` ones (-1: never).

    Activity (0) puts the silence's alarm off, dispose (1) closes at once and takes the alarm away; at one instant activity goes first,
    then dispose, then the alarm. A close is told if the key was never summed up or has ``least`` new messages, which else wait for the next one.
    """

    def close(state: Numbers, at: int, reason: str) -> tuple[Numbers, list[tuple[int, str, int]]]:
        _, total, told = state
        fire = told < 0 or total - told >= least
        return (-1, total, total if fire else told), [(at, reason, total)] if fire else []

    def step(state: Numbers, at: int, kind: int) -> tuple[Numbers, list[tuple[int, str, int]]]:
        last, total, told = state
        if kind == 0:
            return (max(at, last), total + 1, told), []
        return close(state, at, "disposed" if kind == 1 else "idle")

    return (-1, 0, -1), step, lambda s: s[0] + idle_ms if s[0] >= 0 else -1


def rebuild_step(debounce_ms: int, build_ms: int) -> tuple[Numbers, Step, Callable[[Numbers], int]]:
    """(start, step, due) of rebuilds: ``scheduled`` start (-1: none), end of the running build ``until`` (-1: none), ``pending``, changes ``folded``.

    The first change of a burst schedules a build after ``debounce_ms``, which later ones don't move; a build that comes due while another one
    runs waits for it, and all that wait are one build, ``debounce_ms`` after its end.
    """

    def step(state: Numbers, at: int, kind: int) -> tuple[Numbers, list[tuple[int, str, int]]]:
        scheduled, until, pending, folded = state
        if kind == 0:  # a change
            return (at + debounce_ms if scheduled < 0 else scheduled, until, pending, folded + 1), []
        if until >= 0 and until <= at:  # the build ends
            if pending:
                return (until + debounce_ms if scheduled < 0 else min(scheduled, until + debounce_ms), -1, 0, folded), []
            return (scheduled, -1, 0, folded), []
        if until >= 0:  # one that came due meanwhile
            return (-1, until, 1, folded), []
        return (-1, at + build_ms, 0, 0), [(at, "rebuild", folded)]

    def due(state: Numbers) -> int:
        times = [t for t in state[:2] if t >= 0]
        return min(times) if times else -1

    return (-1, -1, 0, 0), step, due


def limit_step(most: int, window_ms: int) -> tuple[Numbers, Step, Callable[[Numbers], int]]:
    """(start, step, due) of limits: ``most`` rows are accepted in a window that starts at its first use; nothing is ever due."""

    def step(state: Numbers, at: int, kind: int) -> tuple[Numbers, list[tuple[int, str, int]]]:
        start, used = state if state[0] >= 0 and at - state[0] < window_ms else (at, 0)
        return (start, min(used + 1, most)), [(at, "accepted", used + 1)] if used < most else []

    return (-1, 0), step, lambda s: -1


def walk(state: Numbers, rows: list[tuple[int, int]], until: int | None, step: Step, due: Callable[[Numbers], int], alarm: int) -> tuple[Numbers, list[tuple[int, str, int]]]:
    """Take rows (time, kind) in order, and the alarms that are due in between and up to ``until`` (None: no end)."""
    out: list[tuple[int, str, int]] = []
    for at, kind in [*sorted(rows), (until, alarm)]:
        while (d := due(state)) >= 0 and (at is None or d < at or (at == d and kind == alarm)):
            state, told = step(state, d, alarm)
            out += told
        if kind != alarm:
            state, told = step(state, at, kind)
            out += told
    return state, out


def packed(rows: list[tuple[int, int]]) -> tuple[bytes, bytes]:
    """Rows (time, kind) as one value."""
    return array("q", [t for t, _ in rows]).tobytes(), bytes(k for _, k in rows)


def unpacked(times: bytes, kinds: bytes) -> list[tuple[int, int]]:
    at = array("q")
    at.frombytes(bytes(times))
    return list(zip(at, bytes(kinds), strict=True))


class Timed(StatefulProcessor):
    """A key's rows in order of time, and its alarms, by a start, a step and a rule of what is due.

    Each touch of the state is a message to the engine, so the numbers and the timer are one value, and the rows of a batch that wait are another.
    """

    #: Kinds of rows are 0 and 1; an alarm is another one.
    ALARM = 2

    def __init__(self, start: Numbers, step: Step, due: Callable[[Numbers], int], key: str, event_time: bool, ttl_ms: int | None) -> None:
        self.start, self.step, self.due, self.key, self.event_time, self.ttl_ms = start, step, due, key, event_time, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.own = handle.getValueState("own", "numbers array<long>, timer long", self.ttl_ms)
        self.waiting = handle.getListState("waiting", "times binary, kinds binary", self.ttl_ms)
        self.told = Row(self.key, "ms", "reason", "n")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        now = self._now(timerValues)
        fresh = [(r[2] if self.event_time else now, r[3]) for r in rows]
        yield from self._advance(key, fresh, now, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._advance(key, [], max(self._now(timerValues), expiredTimerInfo.getExpiryTimeInMs()), True)

    def close(self) -> None:
        pass

    def _now(self, values: Any) -> int:
        return values.getCurrentWatermarkInMs() if self.event_time else values.getCurrentProcessingTimeInMs()

    def _advance(self, key: Any, fresh: list[tuple[int, int]], now: int, fired: bool) -> Iterator[Row]:
        passed = [r for r in fresh if r[0] <= now]
        held = [r for r in fresh if r[0] > now]
        own = self.own.get()
        state, timer = (tuple(own[0]), own[1]) if own else (self.start, None)
        # Rows that wait are read again only where some of them, or an alarm, may have come due; without a timer none wait.
        if timer is None or fired or timer <= now or passed:
            chunks = list(self.waiting.get()) if timer is not None else []
            old = [r for c in chunks for r in unpacked(*c)]
            passed += [r for r in old if r[0] <= now]
            held += [r for r in old if r[0] > now]
            state, told = walk(state, passed, now, self.step, self.due, self.ALARM)
            if held:
                self.waiting.put([packed(held)])
            elif chunks:
                self.waiting.clear()
            times = [r[0] for r in held] + ([self.due(state)] if self.due(state) >= 0 else [])
            self.own.update((list(state), self._set(None if fired else timer, min(times) if times else None, now)))
        else:
            told = []
            self.waiting.appendValue(packed(held))
            if held and min(held)[0] < timer:
                self.own.update((list(state), self._set(timer, min(held)[0], now)))
        for at, reason, n in told:
            yield self.told(key[0], at, reason, n)

    def _set(self, old: int | None, new: int | None, now: int) -> int | None:
        """The timer that holds from now on."""
        new = max(new, now + 1) if new is not None else None
        if new != old:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)
        return new


def _timed(rows: DataFrame, key: str, rules: tuple, late: str | None, ttl_ms: int | None) -> DataFrame:
    """``key, ms, reason, n`` told by the rules over ``rows`` of ``key, ts, kind``; without ``late`` on arrival, with state that ``ttl_ms`` forgets."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    shape = f"{key} {dict(rows.dtypes)[key]}, ms long, reason string, n long"
    told = (rows.withWatermark("ts", late) if late else rows).select(key, "ts", F.unix_millis("ts").alias("ms"), "kind")
    processor = Timed(*rules, key, late is not None, None if late else ttl_ms)
    return told.groupBy(key).transformWithState(statefulProcessor=processor, outputStructType=shape, outputMode="Append", timeMode="EventTime" if late else "ProcessingTime")


def session_closes(events: DataFrame, key: str, disposed: str, idle_ms: int = 300_000, least: int = 4, late: str | None = "10 minutes", ttl_ms: int | None = 14 * 86_400_000) -> DataFrame:
    """``key, ms, reason (idle, disposed), n``: closes of a key's sessions, each once, with the messages so far.

    ``disposed`` is a SQL condition on ``events`` (with ``ts``) that tells dispose events; all others are activity.
    """
    rows = events.select(key, "ts", F.coalesce(F.expr(disposed), F.lit(False)).cast("int").alias("kind"))
    return _timed(rows, key, close_step(idle_ms, least), late, ttl_ms)


def rebuilds(changes: DataFrame, key: str, debounce_ms: int = 100, build_ms: int = 1000, late: str | None = "1 minute", ttl_ms: int | None = 86_400_000) -> DataFrame:
    """``key, ms, reason, n``: builds that bursts of changes (``key, ts``) are folded into, with the changes that each takes up."""
    return _timed(changes.select(key, "ts", F.lit(0).alias("kind")), key, rebuild_step(debounce_ms, build_ms), late, ttl_ms)


def rate_limited(events: DataFrame, key: str, most: int = 5, window_ms: int = 1_800_000, late: str = "10 minutes") -> DataFrame:
    """``key, ms, reason, n``: rows of a key that are accepted, ``most`` of them in a window that starts at its first use; each once, when it is certain."""
    return _timed(events.select(key, "ts", F.lit(0).alias("kind")), key, limit_step(most, window_ms), late, None)


def finished_and_closed(spark: SparkSession, stream: Callable[[str], DataFrame], path: str, closing: DataFrame) -> DataFrame:
    """Run ``stream`` over all files of ``path``, then go on from the same checkpoint with ``closing`` rows, whose times pass the watermark over all the others."""
    folder = scratch_folder(spark, "stream")
    closing.write.parquet(f"{folder}/closing")
    schema = None
    for source in (path, f"{folder}/closing"):
        rows = stream(source)
        schema = rows.schema
        rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")
