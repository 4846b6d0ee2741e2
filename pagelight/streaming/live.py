"""Live forms: windowed counts, envelope decoding and request admission on streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pagelight.operators import events
from pagelight.sources import reports


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Append-only parquet folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def live_window_counts(stream: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    return events.window_counts(stream.withWatermark("ts", late), size, slide)


def live_session_counts(stream: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    return events.session_counts(stream.withWatermark("ts", late), gap)


def _time_mode(late: str | None) -> str:
    """Timers run by event time where the stream has a watermark."""
    return "None" if late is None else "EventTime"


def _expire_at(handle: StatefulProcessorHandle, seconds: float | None) -> None:
    """The one timer of the current key, or none."""
    at = None if seconds is None else int(seconds * 1000) + 1
    known = list(handle.listTimers())
    for timer in known:
        if timer != at:
            handle.deleteTimer(timer)
    if at is not None and at not in known:
        handle.registerTimer(at)


def _in_order(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """The rows of one key and trigger in order, however many batches they come in; the size of a trigger bounds them."""
    return pd.concat(list(rows)).sort_values(order)


class StageRuns(StatefulProcessor):
    """Keeps the open start of one (run, stage), with timers for ``longest`` seconds of event time."""

    def __init__(self, longest: float | None):
        self.longest = longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "ts timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        started = pd.Timestamp(self.open.get()[0]) if self.open.exists() else None
        spans = []
        part = _in_order(rows, ["ts", "event_id"])
        for phase, ts in zip(part["phase"], part["ts"]):
            if started is not None and self.longest is not None and (ts - started).total_seconds() > self.longest:
                started = None
            if phase == "start":
                started = ts
            elif phase == "end" and started is not None:
                spans.append(round((ts - started).total_seconds(), 3))
                started = None
        if started is None:
            self.open.clear()
        else:
            self.open.update((started.to_pydatetime(),))
        if self.longest is not None:
            # Times come without a zone, in the zone of the session; the column of seconds has none.
            last = part["at_s"][part["ts"] == started]
            if started is None:
                _expire_at(self.handle, None)
            elif len(last):
                _expire_at(self.handle, last.iloc[-1] + self.longest)
        yield pd.DataFrame({"run_id": key[0], "stage": key[1], "duration_s": pd.Series(spans, dtype="float64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.open.clear()
        return iter(())

    def close(self) -> None:
        pass


def live_stage_durations(stream: DataFrame, late: str | None = None, longest: float | None = None) -> DataFrame:
    """One row per finished run of a (run, stage), whenever it started; needs the RocksDB state store.

    Events of a key arrive in time order from trigger to trigger; ``stream`` has run_id, stage, phase, ts, event_id.
    With a watermark of ``late`` and ``longest``, a start without an end for more than ``longest`` seconds of event time
    is forgotten, by a timer once the watermark is past it, and rows behind the watermark are dropped and counted in
    the progress by Spark.  Without both, an open start waits for its end.
    """
    if (late is None) != (longest is None):
        raise ValueError("late and longest go together")
    stream = stream.withColumn("at_s", F.unix_micros("ts") / F.lit(1e6))
    if late is not None:
        stream = stream.withWatermark("ts", late)
    return stream.groupBy("run_id", "stage").transformWithStateInPandas(
        statefulProcessor=StageRuns(longest), outputStructType="run_id string, stage string, duration_s double",
        outputMode="Append", timeMode=_time_mode(late))


def live_envelopes(stream: DataFrame) -> DataFrame:
    return reports.decode_envelopes(stream)[0]


class Admission(StatefulProcessor):
    """Keeps the admitted times of the last window of one (client, bucket)."""

    def __init__(self, limits: dict[str, int], window: float, timed: bool):
        self.limits, self.window, self.timed = limits, window, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "t double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        client, bucket = key
        kept = deque(sorted(r[0] for r in self.times.get()))
        part = _in_order(rows, ["t", "id"])
        ok, wait = [], []
        for t in part["t"]:
            while kept and t - kept[0] >= self.window:
                kept.popleft()
            free = len(kept) < self.limits[bucket]
            ok.append(free)
            wait.append(0 if free else int(self.window - (t - kept[0])) + 1)
            if free:
                kept.append(t)
        if kept:
            self.times.put([(float(k),) for k in kept])
        else:
            self.times.clear()
        if self.timed:
            _expire_at(self.handle, kept[-1] + self.window if kept else None)
        yield pd.DataFrame({"client": client, "bucket": bucket, "id": part["id"], "t": part["t"], "admitted": ok, "retry_after": wait})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        return iter(())

    def close(self) -> None:
        pass


def live_admission(
    request: DataFrame, limits: dict[str, int], window: float = events.WINDOW_SECONDS, late: str | None = None
) -> DataFrame:
    """Admission with list state per key; needs the RocksDB state store.

    ``t`` counts seconds.  With a watermark of ``late`` a key leaves the state by a timer once the watermark is a window past its
    last admitted request; no request that may still come could be refused for it, so answers stay those of the
    batch.  Requests behind the watermark are dropped and counted in the progress by Spark.  Without ``late`` keys stay.
    """
    if late is not None:
        request = request.withColumn("at", F.timestamp_micros((F.col("t") * 1e6).cast("bigint"))).withWatermark("at", late)
    return request.groupBy("client", "bucket").transformWithStateInPandas(
        statefulProcessor=Admission(limits, window, late is not None),
        outputStructType="client bigint, bucket string, id bigint, t double, admitted boolean, retry_after int",
        outputMode="Append", timeMode=_time_mode(late),
    )
