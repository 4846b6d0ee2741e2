"""Telemetry, stages, remediation events and request admission."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelight.functions import scan

UPLOAD_LIMIT, DEFAULT_LIMIT, WINDOW_SECONDS = 10, 60, 60.0
ERROR_CHARS = 2000  # of the short form of an error text


def admission(request: DataFrame, limits: dict[str, int], window: float = WINDOW_SECONDS) -> DataFrame:
    """Sliding-window admission per (client, bucket): rejected requests do not count.

    ``request`` has client, bucket, id and t (seconds).  A request with fewer requests than the limit in the window before it
    is admitted, whatever happened to those; one look at the request ``limit`` places before it says so.  Only
    the others, and what is in the window before them, depend on earlier admissions.  They fall into chains: where two of them are a
    whole window apart, the requests in between that matter to the second are all admitted, so it needs nothing of
    the first.  A chain is walked in order by one task with at most ``limit`` remembered times; the walk goes from one
    admitted request to the next and skips the rejected ones in between.  A bucket without a limit admits everything.
    """
    keys = ["client", "bucket"]
    flagged = _pressure(request, limits, window)
    free = flagged.filter("NOT busy").select(*keys, "id", "t", F.lit(True).alias("admitted"), F.lit(0).alias("retry_after"))
    first = f"unsure AND (before IS NULL OR t - before >= {window})"
    chain = scan.running(
        flagged.filter("busy").select(*keys, "id", "t", "unsure", "before", "after"), keys, ["t", "id"],
        {"__chain": scan.running_sum(F.expr(f"CAST({first} AS INT)"))}, segment=[_segment(window)])
    later = f"NOT unsure AND (before IS NULL OR after - before >= {window})"
    ordered = chain.withColumn("mark", F.expr(f"xxhash64(client, bucket, __chain + CAST({later} AS INT))")).select(
        *keys, "id", "t", "mark").repartition("mark").sortWithinPartitions("mark", "t", "id")
    schema = free.drop("admitted", "retry_after").schema.add("admitted", "boolean").add("retry_after", "integer")
    return free.unionByName(ordered.mapInArrow(_walk(limits, window), schema))


SEGMENT_WINDOWS = 16  # windows in a segment of time, the unit of parallelism of one client


def _segment(window: float):
    return F.floor(F.col("t") / (SEGMENT_WINDOWS * window))


def _pressure(request: DataFrame, limits: dict[str, int], window: float) -> DataFrame:
    """Requests with ``unsure``: the limit may bind; ``before`` and ``after``: times of the unsure requests next to it; ``busy``: it is
    unsure or in the window before one.

    Segments of time are looked at on their own, with copies of the requests up to three windows before and two after them.
    """
    size = SEGMENT_WINDOWS * window
    copies = F.array_compact(F.array(
        F.col("home"), F.when(F.col("t") >= (F.col("home") + 1) * size - 3 * window, F.col("home") + 1),
        F.when(F.col("t") < F.col("home") * size + 2 * window, F.col("home") - 1)))
    spread = request.select("client", "bucket", "id", "t").withColumn("home", _segment(window)).select(
        "*", F.explode(copies).alias("segment"))
    part = Window.partitionBy("client", "bucket", "segment")
    up, down = part.orderBy("t", "id"), part.orderBy(F.desc("t"), F.desc("id"))
    back = reduce(lambda c, b: c.when(F.col("bucket") == b, F.lag("t", limits[b]).over(up)), limits, F)
    unsure = spread.withColumn("unsure", F.coalesce(F.col("t") - back < window, F.lit(False)))
    when = F.when(F.col("unsure"), F.col("t"))
    seen = unsure.withColumn("before", F.last(when, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "after", F.last(when, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return seen.filter("segment = home").withColumn("busy", F.coalesce(F.col("after") - F.col("t") < window, F.lit(False)))


def _walk(limits: dict[str, int], window: float):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, memory = None, deque()
        for batch in batches:
            mark, t = batch.column("mark").to_numpy(), batch.column("t").to_numpy()
            bucket = batch.column("bucket")
            ok, wait = np.zeros(len(t), bool), np.zeros(len(t), np.int32)
            edges = [0, *(np.flatnonzero(np.diff(mark)) + 1).tolist(), len(t)]
            for lo, hi in zip(edges, edges[1:]):
                if hi == lo:
                    continue
                if mark[lo] != current:
                    current, memory, limit = mark[lo], deque(), limits[bucket[lo].as_py()]
                i = lo
                while i < hi:
                    while memory and t[i] - memory[0] >= window:
                        memory.popleft()
                    if len(memory) < limit:
                        memory.append(t[i])
                        ok[i] = True
                        i += 1
                        continue
                    j = int(np.searchsorted(t[i:hi], memory[0] + window)) + i
                    while j < hi and t[j] - memory[0] < window:  # a sum and a difference may round apart
                        j += 1
                    while j > i + 1 and t[j - 1] - memory[0] >= window:
                        j -= 1
                    wait[i:j] = (window - (t[i:j] - memory[0])).astype(np.int32) + 1
                    i = j
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("client", "bucket", "id", "t")), pa.array(ok), pa.array(wait)],
                names=["client", "bucket", "id", "t", "admitted", "retry_after"])

    return walk


def stage_durations(event: DataFrame) -> DataFrame:
    """Duration in seconds per (run, stage), and how often the stage was run.

    An end closes the start right before it; a start without its own end, and an end without its own start,
    count for nothing.  A stage that is run again keeps the duration of its last run.  Of events at one time
    the smaller ``event_id`` comes first.
    """
    marks = event.filter("phase IN ('start', 'end')")
    seen = scan.running(marks.select("run_id", "stage", "phase", "ts", "event_id"), ["run_id", "stage"], ["ts", "event_id"], {
        "__phase": scan.previous(F.col("phase")), "__ts": scan.previous(F.col("ts"))},
        segment=[F.date_trunc("day", "ts")])
    closed = "phase = 'end' AND __phase = 'start'"
    seconds = "bround(timestampdiff(MICROSECOND, __ts, ts) / 1000000.0D, 3)"
    spans = seen.groupBy("run_id", "stage").agg(
        F.expr(f"max_by({seconds}, struct(ts, event_id)) FILTER (WHERE {closed}) AS duration_s"), F.expr(f"count_if({closed}) AS n_runs"))
    every = event.select("run_id", "stage").distinct()
    return every.join(spans, ["run_id", "stage"], "left").selectExpr("run_id", "stage", "duration_s", "coalesce(n_runs, 0) AS n_runs")


def run_records(event: DataFrame, stages: list[str]) -> DataFrame:
    """One telemetry row per run: a column per stage, total time, status, the failed stage and the error.

    ``error_message`` is the whole text of the last failure, ``error_summary`` its first ``ERROR_CHARS`` characters.
    """
    durations = stage_durations(event).groupBy("run_id").pivot("stage", stages).agg(F.expr("max(duration_s)"))
    totals = event.groupBy("run_id").agg(
        F.expr("bround(timestampdiff(MICROSECOND, min(ts), max(ts)) / 1000000.0D, 3) AS total_duration_s"),
        F.expr("CASE WHEN bool_or(phase = 'failed') THEN 'failed' ELSE 'success' END AS status"),
        F.expr("max_by(message, struct(ts, event_id)) FILTER (WHERE phase = 'failed') AS error_message"),
        F.expr(f"substr(max_by(message, struct(ts, event_id)) FILTER (WHERE phase = 'failed'), 1, {ERROR_CHARS}) AS error_summary"),
        F.expr("max_by(stage, struct(ts, event_id)) FILTER (WHERE phase = 'failed') AS error_stage"))
    named = durations.select("run_id", *[F.col(f"`{s}`").alias(f"{s}_duration_s") for s in stages])
    return totals.join(named, "run_id")


def overall_status(stage: DataFrame) -> DataFrame:
    return stage.groupBy("run_id").agg(F.expr(
        """CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status IN ('degraded', 'skipped')) THEN 'degraded'
         ELSE 'success' END AS overall_status"""))


# Outcome of a stage by policy and what happened: a failure of an optional stage never fails a run.
STAGE_OUTCOME = """CASE outcome WHEN 'done' THEN 'success'
 ELSE CASE category WHEN 'required' THEN 'failed' WHEN 'required_with_fallback' THEN 'degraded' ELSE 'skipped' END END"""


def stage_outcomes(stage: DataFrame) -> DataFrame:
    return stage.withColumn("status", F.expr(STAGE_OUTCOME))


def stage_invariants(stage: DataFrame) -> DataFrame:
    """Success needs evidence metadata; any other status needs a warning or an error."""
    return stage.selectExpr(
        "run_id", "stage",
        """CASE WHEN status = 'success' AND coalesce(size(metadata), 0) = 0 THEN 'success_without_evidence'
         WHEN status <> 'success' AND coalesce(size(warnings), 0) + coalesce(size(errors), 0) = 0 THEN 'unexplained_status' END AS violation""",
    ).filter("violation IS NOT NULL")


# Repaired components.
COMPONENTS = ("AltText", "HeadingHierarchy", "TableStructure", "FigureCaption", "LanguageTag", "MarkInfo", "PDFUAMetadata",
              "ViewerPreferences", "TabOrder", "CIDSetRemoval")


def task_events(event: DataFrame) -> DataFrame:
    """Events per task in time order with their running number and the task's count.

    The ordered form is rows, not one array per task, so a task of any length spreads.
    """
    numbered = scan.running(event, ["task_id"], ["ts", "event_id"], {"ord": scan.row_position()},
                            segment=[F.date_trunc("day", "ts")])
    counts = event.groupBy("task_id").agg(F.expr("count(*) AS n"))
    return numbered.join(counts, "task_id")


def events_by_component(event: DataFrame) -> DataFrame:
    return event.groupBy("component").agg(F.expr("count(*) AS n"), F.expr("min(ts) AS first_ts"), F.expr("max(ts) AS last_ts"))


def recent_tasks(event: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` tasks by their latest event."""
    last = event.groupBy("task_id").agg(F.expr("max(ts) AS last_ts"), F.expr("count(*) AS events"))
    return last.orderBy(F.col("last_ts").desc(), "task_id").limit(n)


BUCKETS = (0.5, 1, 2, 5, 10, 30, 60, 120, 300)


def duration_histogram(durations: DataFrame) -> DataFrame:
    """Cumulative bucket counts per stage."""
    counts = durations.groupBy("stage").agg(
        F.expr("count(duration_s) AS n"), F.expr("sum(duration_s) AS total"),
        *[F.expr(f"count_if(duration_s <= {b}) AS le_{str(b).replace('.', '_')}") for b in BUCKETS])
    rows = ", ".join(f"named_struct('le', CAST({b} AS DOUBLE), 'cumulative', le_{str(b).replace('.', '_')})" for b in BUCKETS)
    return counts.selectExpr("stage", "n", f"inline(array({rows}))")


def status_counts(run: DataFrame) -> DataFrame:
    return run.groupBy("status").agg(F.expr("count(*) AS n"), F.expr("max_by(score, ts) AS last_score"))


def window_counts(event: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Tumbling or sliding counts; with a watermark on a stream."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return event.groupBy(w, "event_type").agg(F.expr("count(*) AS n")).select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n")


def session_counts(event: DataFrame, gap: str) -> DataFrame:
    return event.groupBy(F.session_window("ts", gap), "user_id").agg(F.expr("count(*) AS n")).select(
        F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")
