"""Frames of trials in progress, as keyed state with timers: when a trial's picture is due, and what it shows.

Every trial has one state: its last event, whether a model is at work, since when it runs and when it was last shown. A
frame is due at a trial's first event, at each start and end, on an event when the last frame is old enough, and by a
processing-time timer when no event comes at all. With the end goes the trial's state; a mark that it has ended stays for
a while, so that late events draw nothing, and expires by itself.

State lives in the state store under the query's checkpoint: a restarted query goes on with its trials, and with their
timers from its first batch of events. A
trial's events of one batch are read once, in any order; of them only the last by number is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

START, SENT, END = "trial-start", "request-sent", "trial-end"
#: Kinds after which no model is at work.
RESTS = ("attempt", START, END)
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_LONG, _TEXT, _FLAG = T.LongType(), T.StringType(), T.BooleanType()
_STATE = T.StructType([T.StructField(n, t) for n, t in (("seq", _LONG), ("kind", _TEXT), ("snapshot", _TEXT), ("events", _LONG), ("sent", _LONG), ("rest", _LONG), ("since", _LONG), ("shown", _LONG), ("frames", _LONG))])
_MARK = T.StructType([T.StructField("seq", _LONG)])


def frame_type(key: T.DataType) -> T.StructType:
    kinds = (("trial_id", key), ("frame", _LONG), ("cause", _TEXT), ("elapsed_ms", _LONG), ("last_seq", _LONG), ("last_kind", _TEXT), ("last_snapshot", _TEXT), ("events", _LONG), ("working", _FLAG), ("ended", _FLAG))
    return T.StructType([T.StructField(n, t) for n, t in kinds])


class Frames(StatefulProcessor):
    """``redraw_ms``: the least time between two frames; without ``terminal``, only the frame of a trial's end is shown."""

    def __init__(self, redraw_ms: int = 1000, ended_ms: int = 60_000, terminal: bool = True):
        self.redraw_ms, self.ended_ms, self.terminal = redraw_ms, ended_ms, terminal

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.trial = handle.getValueState("trial", _STATE)
        self.mark = handle.getValueState("ended", _MARK, ttlDurationMs=self.ended_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        now = timerValues.getCurrentProcessingTimeInMs()
        old, mark = self.trial.get(), self.mark.get()
        done = mark[0] if mark is not None else None
        seq, kind, snapshot, events, sent, rest, since, shown, frames = old or (-1, None, None, 0, -1, -1, now, None, 0)
        started, end = False, -1
        for r in rows:
            if done is not None and r["seq"] <= done:
                continue  # late: the trial has ended
            events += 1
            started |= r["kind"] == START
            if r["kind"] == END:
                end = max(end, r["seq"])
            if r["kind"] == SENT:
                sent = max(sent, r["seq"])
            elif r["kind"] in RESTS:
                rest = max(rest, r["seq"])
            if r["seq"] > seq:
                seq, kind, snapshot = r["seq"], r["kind"], r["snapshot"]
        if kind is None or (old is not None and events == old[3]):
            return
        ended = end >= 0 and end >= seq
        cause = "end" if ended else "first" if old is None else "start" if started else "event" if shown is None or now - shown >= self.redraw_ms else None
        if not self.terminal and not ended:
            cause = None
        if cause:
            shown, frames = now, frames + 1
        state = (seq, kind, snapshot, events, sent, rest, since, shown, frames)
        if ended:
            self._forget(seq)
        else:
            self.trial.update(state)
            if cause and self.terminal:
                self._due(now + self.redraw_ms)
        if cause:
            yield self._frame(key, cause, now, state, ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        state = self.trial.get()
        if state is None:
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        state = (*state[:7], now, state[8] + 1)
        self.trial.update(state)
        self._due(now + self.redraw_ms)
        yield self._frame(key, "timer", now, state, False)

    def _due(self, at: int) -> None:
        """One timer a trial: the time of its next frame."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def _forget(self, seq: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.trial.clear()
        self.mark.update((seq,))

    @staticmethod
    def _frame(key, cause: str, now: int, s: tuple, ended: bool) -> Row:
        return Row(trial_id=key[0], frame=s[8], cause=cause, elapsed_ms=now - s[6], last_seq=s[0], last_kind=s[1], last_snapshot=s[2], events=s[3], working=s[4] > s[5], ended=ended)

    def close(self) -> None:
        pass


def frames(events: DataFrame, **options) -> DataFrame:
    """A stream of frames of a stream of events (trial_id, seq, kind, snapshot)."""
    cols = events.select("trial_id", events["seq"].cast("long").alias("seq"), events["kind"].cast("string").alias("kind"), events["snapshot"].cast("string").alias("snapshot"))
    known = cols.where("trial_id is not null and seq is not null and kind is not null")
    return known.groupBy("trial_id").transformWithState(statefulProcessor=Frames(**options), outputStructType=frame_type(events.schema["trial_id"].dataType), outputMode="Update", timeMode="ProcessingTime")


def watch_frames(events: DataFrame, draw: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second", **options) -> StreamingQuery:
    """Hand the frames that are due to an observer, batch by batch; timers need a session whose state store has timers."""
    if events.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STORE:
        events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return frames(events, **options).writeStream.outputMode("update").trigger(processingTime=every).option("checkpointLocation", checkpoint).foreachBatch(draw).start()
