"""Tasks that fall silent, found while the heartbeats stream in."""

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from runlens.functions import blocks
from runlens.functions.states import seconds_between

SILENCES = "task_key string, last_beat long, silent_since long"
_EPOCH = dt.datetime(1970, 1, 1)


class _Silence(StatefulProcessor):
    """State is the time of the newest beat of a task and of its end; a timer fires one threshold after the beat.

    The end is forgotten when the watermark has passed it: what is older is dropped
    before it gets here, so tasks that have ended hold no state.

    A batch may hold many beats of a task while a timer only sees the last,
    so the beats of a batch are scanned in order as well. A beat that arrives
    late moves nothing back: one older than the newest beat is passed over, and
    so is one from before the task's end.
    """

    def __init__(self, threshold: float) -> None:
        self.threshold = round(threshold * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "beat timestamp")
        self.ended = handle.getValueState("ended", "at timestamp")

    @staticmethod
    def _held(state) -> int | None:
        found = state.get()
        return None if found is None else (found[0] - _EPOCH) // dt.timedelta(microseconds=1)

    @staticmethod
    def _hold(state, at: int | None) -> None:
        if at is None:
            state.clear()
        else:
            state.update((_EPOCH + dt.timedelta(microseconds=at),))

    @staticmethod
    def _after(at: int) -> int:
        """The first whole millisecond after a time."""
        return at // 1000 + 1

    def _timers(self, last: int | None, ended: int | None) -> set[int]:
        """The timers that go with a state: what is held tells them, they need not be listed."""
        due = set() if ended is None else {self._after(ended)}
        return due if last is None else due | {self._after(last + self.threshold)}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        beats = [(row["at"], row["seq"] is None, row["seq"] or 0, row["kind"]) for row in rows]
        beats.sort(key=lambda beat: beat[:3])
        old = last, ended = self._held(self.last), self._held(self.ended)
        for at, _, _, kind in beats:
            if (ended is not None and at <= ended) or (last is not None and at < last):
                continue
            if last is not None and at - last > self.threshold:
                yield Row(task_key=key[0], last_beat=last, silent_since=last + self.threshold)
            if kind == "terminal":
                last, ended = None, at
            else:
                last = at
        before, now = self._timers(*old), self._timers(last, ended)
        for due in before - now:
            self.handle.deleteTimer(due)
        for due in now - before:
            self.handle.registerTimer(due)
        for state, was, at in ((self.last, old[0], last), (self.ended, old[1], ended)):
            if at != was:
                self._hold(state, at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        ended, last = self._held(self.ended), self._held(self.last)
        if ended is not None and self._after(ended) <= now:
            self.ended.clear()
        if last is not None and self._after(last + self.threshold) <= now:
            self.last.clear()
            yield Row(task_key=key[0], last_beat=last, silent_since=last + self.threshold)

    def close(self) -> None:
        pass


def stream_zombies(heartbeats: DataFrame, threshold: float, delay: str = "1 minute") -> DataFrame:
    """A row per silence longer than `threshold` seconds.

    `heartbeats` has (task_key, beat_at, seq, kind); kind `terminal` ends the
    watch of a task. Beats behind the watermark are dropped. Run with the
    RocksDB state store.
    """
    watched = heartbeats.withColumn("beat_at", F.col("beat_at").cast("timestamp")).withColumn("at", F.unix_micros("beat_at"))
    found = (
        watched.withWatermark("beat_at", delay).groupBy("task_key")
        .transformWithState(
            statefulProcessor=_Silence(threshold), outputStructType=SILENCES,
            outputMode="Append", timeMode="EventTime",
        )
    )
    return found.select("task_key", *[F.timestamp_micros(c).alias(c) for c in ("last_beat", "silent_since")])


def silences(heartbeats: DataFrame, threshold: float, now: Column) -> DataFrame:
    """Batch form: beats followed by a longer pause. The pause after a task's last
    beat lasts until `now`; its row has no next beat."""
    paired = blocks.neighbour(
        heartbeats, ["task_key"], ["beat_at", "seq"], {"next_beat": "beat_at"}, following=True
    )
    pause = seconds_between(F.col("beat_at"), F.coalesce("next_beat", now))
    return paired.filter((F.col("kind") != "terminal") & (pause > threshold)).select(
        "task_key", F.col("beat_at").alias("last_beat"), "next_beat"
    )
