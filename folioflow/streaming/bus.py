"""An event bus on keyed state: mailboxes of subscribers, heartbeats of quiet ones, jobs waiting and running in pools.

Each is a processor of Spark's state API, so state is bounded by what its docstring says, lives in checkpoints and moves with
its key. Within a micro-batch a key's events are taken in the order of their time and id.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import chain
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

MOST, IDLE_S, FORGET_S = 500, 15, 7 * 24 * 3600
#: What a subscriber says to get events of all kinds.
ALL = "*"
#: Kinds of a pool's events by their number, 0 for all others; rows of a frame that a pool gives out.
KINDS, FRAME = ("other", "queued", "started", "progress", "finished"), 10_000


def _in_order(rows: Iterator[pd.DataFrame], columns: list[str]) -> list[np.ndarray]:
    """Columns of a key's rows by ``us`` and ``event_id``, held as plain arrays."""
    parts: list[list[np.ndarray]] = [[], [], *([] for _ in columns)]
    for frame in rows:
        for part, name in zip(parts, ["us", "event_id", *columns], strict=True):
            part.append(frame[name].to_numpy())
    whole = [np.concatenate(p) for p in parts]
    order = np.lexsort((whole[1], whole[0]))
    return [x[order] for x in whole]


def fan_out(stream: DataFrame, subscribers: DataFrame, most: int = MOST) -> DataFrame:
    """STM01: events (event_id, us, kind) dealt to subscribers (subscriber, kind): (subscriber, us, event_id, skipped).

    A subscriber has a row for each kind it wants, or one for ``ALL``. Of each batch of rows that a task reads, only a
    subscriber's ``most`` latest events go on; ``skipped`` counts the others, in a row without an event. So a subscriber
    to everything costs ``most`` rows a batch in the shuffle and not all events.
    """
    kinds = stream.select("event_id", "us", F.explode(F.array("kind", F.lit(ALL))).alias("kind"))
    dealt = kinds.join(subscribers, "kind").select("subscriber", "us", "event_id")

    def trim(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.sort_values(["us", "event_id"])
            last = frame.groupby("subscriber", sort=False).cumcount(ascending=False) < most
            gone = frame.loc[~last].groupby("subscriber", as_index=False).size()
            yield frame.loc[last].assign(skipped=0)
            if len(gone):
                empty = np.full(len(gone), -1)
                yield pd.DataFrame({"subscriber": gone["subscriber"], "us": empty, "event_id": empty, "skipped": gone["size"]})

    return dealt.mapInPandas(trim, "subscriber string, us long, event_id long, skipped long")


class Mailbox(StatefulProcessor):
    """A subscriber's latest ``most`` events, oldest dropped first, and how many were dropped; that is all of its state."""

    def __init__(self, most: int) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.queue = handle.getListState("queue", "us long, event_id long")
        self.dropped = handle.getValueState("dropped", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(map(int, x)) for x in self.queue.get()] if self.queue.exists() else []
        dropped = int(self.dropped.get()[0]) if self.dropped.exists() else 0
        n = [len(held)]

        def arriving() -> Iterator[tuple[int, int]]:
            nonlocal dropped
            for frame in rows:
                dropped += int(frame["skipped"].sum())
                own = frame[frame["event_id"] >= 0]
                n[0] += len(own)
                yield from zip(own["us"].tolist(), own["event_id"].tolist(), strict=True)

        held = sorted(heapq.nlargest(self.most, chain(held, arriving())))
        dropped += n[0] - len(held)
        self.queue.put(held)
        self.dropped.update((dropped,))
        yield pd.DataFrame({"subscriber": [key[0]], "dropped": [dropped], "events": [[e for _, e in held]]})


def mailboxes(stream: DataFrame, subscribers: DataFrame, most: int = MOST) -> DataFrame:
    """STM01: (subscriber, dropped, events) after each micro-batch that had something for it: a bounded queue a subscriber."""
    dealt = fan_out(stream, subscribers, most)
    return dealt.groupBy("subscriber").transformWithStateInPandas(
        Mailbox(most), "subscriber string, dropped long, events array<long>", "update", "None"
    )


class Heartbeats(StatefulProcessor):
    """The time that a key was last heard of or had a heartbeat, and a timer."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def _until(self, last: int, end: int) -> np.ndarray:
        """Heartbeats after ``last``, before ``end``."""
        return np.arange(last + self.idle_ms, end, self.idle_ms, dtype=np.int64)

    def _wait(self, last: int) -> None:
        self.last.update((last,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.idle_ms)

    def _rows(self, key: Any, beats: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"subscriber": np.full(len(beats), key[0], object), "beat_ms": beats})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = np.sort(np.concatenate([f["us"].to_numpy() // 1000 for f in rows]))
        last = int(self.last.get()[0]) if self.last.exists() else int(times[0])
        found = []
        for at in times.tolist():
            found.append(self._until(last, at))
            last = max(last, at)
        self._wait(last)
        return iter([self._rows(key, np.concatenate(found))])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = int(self.last.get()[0])
        beats = self._until(last, int(timerValues.getCurrentWatermarkInMs()) + 1)
        self._wait(int(beats[-1]) if len(beats) else last)
        return iter([self._rows(key, beats)])


def heartbeats(stream: DataFrame, idle_s: int = IDLE_S, late: str = "0 seconds") -> DataFrame:
    """STM02: (subscriber, beat_ms): a row each ``idle_s`` without an event of events (subscriber, ts), in event time.

    Silence between two events shows when the later one comes, silence after the last one by a timer on the watermark. An
    event that comes when later heartbeats are out does not take them back. State is one time a subscriber.
    """
    timed = stream.select("subscriber", "ts").withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    return timed.groupBy("subscriber").transformWithStateInPandas(Heartbeats(idle_s * 1000), "subscriber long, beat_ms long", "append", "EventTime")


class Pool(StatefulProcessor):
    """A pool's jobs that wait or run, each with its state, since when, progress and last event; and a timer to forget them.

    A batch's events of a pool are some 33 bytes each in plain arrays while they are put in order; rows go out as they are made.
    """

    def __init__(self, forget_ms: int) -> None:
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "job_id long", "state string, since long, progress double, heard long")

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["pool", "event_id", "job_id", "state", "position", "n_waiting", "n_running", "progress"])
        return frame.astype({"position": "Int64", "progress": "Float64"})

    def _wait(self, heard: list[int]) -> None:
        """A timer for the job that would be forgotten first."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if heard:
            self.handle.registerTimer(min(heard) // 1000 + self.forget_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        since = (int(timerValues.getCurrentWatermarkInMs()) - self.forget_ms) * 1000
        heard = {int(k[0]): int(v[3]) for k, v in self.jobs.iterator()}
        for job in (j for j, at in heard.items() if at <= since):
            self.jobs.removeKey((job,))
        self._wait([at for at in heard.values() if at > since])
        return iter([])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        us, ids, jobs, kinds, values = _in_order(rows, ["job_id", "kind", "value"])
        known = {int(k[0]): (v[0], int(v[1]), float(v[2]), int(v[3])) for k, v in self.jobs.iterator()}
        since = (int(timerValues.getCurrentWatermarkInMs()) - self.forget_ms) * 1000
        changed = {k for k, v in known.items() if v[3] <= since}
        known = {k: v for k, v in known.items() if k not in changed}
        queue = sorted((v[1], k) for k, v in known.items() if v[0] == "waiting")
        running = sum(v[0] == "running" for v in known.values())
        out = []
        for n in range(len(us)):
            t, event, job, kind, value = int(us[n]), int(ids[n]), int(jobs[n]), KINDS[kinds[n]], float(values[n])
            state, since, progress, heard = known.get(job, ("unknown", t, 0.0, t))
            after = state
            if kind == "queued" and state == "unknown":
                after, since = "waiting", t
                insort(queue, (t, job))
            elif kind in ("started", "finished"):
                after = "running" if kind == "started" else "unknown"
                if state == "waiting":
                    del queue[bisect_left(queue, (since, job))]
                running += (after == "running") - (state == "running")
                since, progress = t, 0.0
            elif kind == "progress" and state == "running":
                progress = min(1.0, max(0.0, value / 100))
            if after == "unknown":
                known.pop(job, None)
            else:
                known[job] = (after, since, progress, max(heard, t))
            changed.add(job)
            position = bisect_right(queue, (since, job)) if after == "waiting" else None
            out.append((key[0], event, job, after, position, len(queue), running, progress if after == "running" else None))
            if len(out) == FRAME:
                yield self._frame(out)
                out = []
        for job in changed:
            if job in known:
                self.jobs.updateValue((job,), known[job])
            else:
                self.jobs.removeKey((job,))
        self._wait([v[3] for v in known.values()])
        yield self._frame(out)


def pool_states(stream: DataFrame, forget_s: int = FORGET_S, late: str = "0 seconds") -> DataFrame:
    """STM07: where a job stands after each of the events (event_id, ts, pool, job_id, kind, value) of its pool.

    Kinds are queued, started, progress (a value of 0 to 100) and finished; others change nothing. A job waits from the
    first time it is queued, at a position counted from 1 by time, until it starts, and runs until it is finished. A pool's
    state is its jobs that wait or run; one is forgotten once the watermark is ``forget_s`` past its last event.
    """
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS[1:])), F.col("kind")), F.lit(0)).cast("byte")
    timed = stream.withWatermark("ts", late).select("ts", F.unix_micros("ts").alias("us"), "event_id", "pool", "job_id", kind.alias("kind"), F.col("value").cast("double"))
    schema = "pool long, event_id long, job_id long, state string, position long, n_waiting long, n_running long, progress double"
    return timed.groupBy("pool").transformWithStateInPandas(Pool(forget_s * 1000), schema, "append", "EventTime")
