"""Streams whose events arrive out of order: frames of a session by number, status changes of a task by time.

State is bounded: what waits for an earlier event is kept until that comes or patience ends, by event time, and a key without
events for ``STATE_TTL_MS`` is forgotten. All rows of a key that are ready at once are worked on as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evispark.operators.events import ALLOWED_STEPS
from evispark.streaming.jobs import LATENESS, STATE_TTL_MS

FRAMES = "session_id string, kind string, seq long, until long, event string, payload string"
CHANGES = "task_id long, kind string, seq long, from_status string, to_status string, n_events long"
ENDS = ("final", "error")


class _Timed(StatefulProcessor):
    """One deadline per key: a timer that comes due before it was set anew is none."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "ms long")

    def wait_until(self, ms: int) -> None:
        self.due.update((ms,))
        self.handle.registerTimer(ms)

    def is_due(self, info) -> bool:
        return self.due.exists() and info.getExpiryTimeInMs() >= self.due.get()[0]

    def close(self) -> None:
        pass


class SessionFrames(_Timed):
    """Hands out the gapless prefix of a session's frames, which count from 1."""

    HELD = ("seq", "event", "payload", "ms")

    def __init__(self, patience_ms: int, ttl_ms: int):
        self.patience, self.ttl = patience_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.place = handle.getValueState("place", "next long, ended boolean, newest long")
        self.held = handle.getListState("held", "seq long, event string, payload string, ms long")

    def rows(self, key, kind, seq, until=None, event=None, payload=None) -> pd.DataFrame:
        n = len(seq)
        return pd.DataFrame(
            {
                "session_id": np.repeat(key[0], n), "kind": kind, "seq": np.asarray(seq, np.int64), "until": np.asarray(seq if until is None else until, np.int64),
                "event": [None] * n if event is None else event, "payload": [None] * n if payload is None else payload,
            }
        )

    def waiting(self) -> pd.DataFrame:
        held = list(self.held.get()) if self.held.exists() else []
        return pd.DataFrame.from_records([tuple(r) for r in held], columns=list(self.HELD))

    def handed_out(self, key, ready: pd.DataFrame, ended: bool) -> tuple[pd.DataFrame, bool]:
        """Frames that follow the first end are told apart."""
        ends = ready["event"].isin(ENDS).to_numpy()
        after = ended | (np.cumsum(ends) - ends > 0)
        kind = np.where(after, "after_end", "frame")
        return self.rows(key, kind, ready["seq"], None, ready["event"].to_numpy(), ready["payload"].to_numpy()), bool(ended or ends.any())

    def keep(self, start: int, ended: bool, newest: int, rest: pd.DataFrame) -> None:
        waited = self.held.exists()
        self.place.update((int(start), bool(ended), int(newest)))
        if len(rest):
            self.held.put([(int(s), e, p, int(m)) for s, e, p, m in rest[list(self.HELD)].itertuples(index=False)])
            # The first frame that waits sets the deadline; later ones do not put it off.
            if not waited:
                self.wait_until(int(newest) + self.patience)
        else:
            self.held.clear()
            self.wait_until(int(newest) + self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, ended, newest = self.place.get() if self.place.exists() else (1, False, 0)
        both = pd.concat([self.waiting(), *(frame[list(self.HELD)] for frame in rows)], ignore_index=True)
        again = (both["seq"] < start) | both.duplicated("seq")
        if again.any():
            yield self.rows(key, "duplicate", both["seq"][again], None, both["event"][again].to_numpy(), both["payload"][again].to_numpy())
        fresh = both[~again].sort_values("seq")
        ready = int((fresh["seq"].to_numpy(np.int64) == start + np.arange(len(fresh))).sum())
        if ready:
            out, ended = self.handed_out(key, fresh[:ready], ended)
            yield out
        self.keep(start + ready, ended, max(newest, int(both["ms"].max())), fresh[ready:])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.is_due(expiredTimerInfo):
            return
        if not self.held.exists():
            self.place.clear()
            self.due.clear()
            return
        start, ended, newest = self.place.get()
        rest = self.waiting().sort_values("seq")
        seq = rest["seq"].to_numpy(np.int64)
        expected = np.concatenate([[start], seq[:-1] + 1])
        gaps = seq > expected
        yield self.rows(key, "gap", expected[gaps], seq[gaps] - 1)
        out, ended = self.handed_out(key, rest, ended)
        yield out
        self.keep(seq[-1] + 1, ended, newest, rest[:0])


def session_frames(events: DataFrame, patience: str = "10 minutes", ttl_ms: int = STATE_TTL_MS) -> DataFrame:
    """Frames of each session in order of ``seq``, which counts from 1: session_id, kind, seq, until, event, payload.

    ``events``: session_id, seq, event, payload, ts. kind is ``frame``; ``after_end`` for frames behind a final or error one;
    ``duplicate`` for a number that came before; ``gap`` for the numbers from seq to until that did not come within ``patience``
    after the first frame that waited for them. Within a session, frame, after_end and gap rows come out in order.
    """
    patience_ms = int(pd.Timedelta(patience).total_seconds() * 1000)
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATENESS)
    shaped = timed.select(
        F.col("session_id").cast("string").alias("session_id"), F.col("seq").cast("long").alias("seq"), "event", "payload", "ts", F.unix_millis("ts").alias("ms")
    )
    return shaped.groupBy("session_id").transformWithStateInPandas(SessionFrames(patience_ms, ttl_ms), FRAMES, "append", "eventTime")


class StatusChanges(_Timed):
    """Judges status changes in order of time, once no earlier one can come."""

    HELD = ("us", "seq", "status")

    def __init__(self, ttl_ms: int, allowed=ALLOWED_STEPS, first: str = "queued"):
        self.ttl = ttl_ms
        self.allowed = {">".join(pair) for pair in (("", first), *allowed)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "status string, n long, newest long")
        self.held = handle.getListState("held", "us long, seq long, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = 0
        for frame in rows:
            self.held.appendList([(int(u), int(s), t) for u, s, t in frame[list(self.HELD)].itertuples(index=False)])
            newest = max(newest, int(frame["us"].max()))
            # One timer for each millisecond with events: whatever the watermark passes is judged then.
            for ms in np.unique(-(-frame["us"].to_numpy() // 1000)):
                self.handle.registerTimer(int(ms))
        status, n, before = self.last.get() if self.last.exists() else ("", 0, 0)
        self.last.update((status, n, max(newest, before)))
        self.wait_until(max(newest, before) // 1000 + self.ttl)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        held = pd.DataFrame.from_records([tuple(r) for r in self.held.get()] if self.held.exists() else [], columns=list(self.HELD))
        passed = (held["us"] <= until).to_numpy(bool)
        if passed.any():
            status, n, newest = self.last.get()
            ready = held[passed].sort_values(["us", "seq"])
            to = ready["status"].to_numpy(object)
            came = np.concatenate([[status], to[:-1]])
            wrong = ~(pd.Series(came, dtype=object) + ">" + pd.Series(to, dtype=object)).isin(self.allowed).to_numpy(bool)
            n += len(ready)
            rest = held[~passed]
            if len(rest):
                self.held.put([(int(u), int(s), t) for u, s, t in rest.itertuples(index=False)])
            else:
                self.held.clear()
            self.last.update((str(to[-1]), n, newest))
            yield self.rows(key, "illegal", ready["seq"][wrong], came[wrong], to[wrong], n)
            yield self.rows(key, "latest", ready["seq"][-1:], came[-1:], to[-1:], n)
        if self.is_due(expiredTimerInfo) and not self.held.exists():
            self.last.clear()
            self.due.clear()

    def rows(self, key, kind, seq, came, to, n) -> pd.DataFrame:
        return pd.DataFrame({"task_id": np.repeat(key[0], len(seq)), "kind": kind, "seq": np.asarray(seq, np.int64), "from_status": came, "to_status": to, "n_events": n})


def status_changes(events: DataFrame, ttl_ms: int = STATE_TTL_MS) -> DataFrame:
    """Changes of each task's status in order of (ts, seq): task_id, kind, seq, from_status, to_status, n_events.

    ``events``: task_id, ts, seq, status. A change is judged once the watermark has passed it: kind is ``illegal`` for one that
    the state machine does not allow (the first of a task must be queued), and ``latest`` for the last of those judged together,
    with the task's number of events so far. Events later than the watermark are dropped. A task without events for the
    time of ``ttl_ms`` is forgotten and begins anew.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATENESS)
    shaped = timed.select(F.col("task_id").cast("long").alias("task_id"), F.col("seq").cast("long").alias("seq"), "status", "ts", F.unix_micros("ts").alias("us"))
    return shaped.groupBy("task_id").transformWithStateInPandas(StatusChanges(ttl_ms), CHANGES, "append", "eventTime")
