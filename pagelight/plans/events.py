"""Telemetry, stages, remediation events, admission and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelight.operators import events as V
from pagelight.plans.registry import query
from pagelight.sources import seeded

_T = "CAST(date_diff('microsecond', TIMESTAMP '2024-01-01', ts) AS DOUBLE) / 1000000.0"


@query("sliding_window_admission", f"""WITH RECURSIVE rq AS (SELECT user_id AS client, CASE WHEN event_type = 'purchase' THEN 'upload' ELSE 'default' END AS bucket, event_id AS id, {_T} AS t FROM events),
ev AS (SELECT *, CASE bucket WHEN 'upload' THEN 2 ELSE 5 END AS lim, row_number() OVER (PARTITION BY client, bucket ORDER BY t, id) AS n FROM rq),
walk AS (SELECT client, bucket, n, id, t, [t] AS kept, true AS admitted, 0 AS retry_after FROM ev WHERE n = 1 UNION ALL
 SELECT client, bucket, n, id, t, CASE WHEN len(k) >= lim THEN k ELSE list_append(k, t) END, len(k) < lim, CASE WHEN len(k) >= lim THEN CAST(trunc(86400.0 - (t - k[1])) AS INT) + 1 ELSE 0 END
 FROM (SELECT e.*, list_filter(w.kept, lambda x: e.t - x < 86400.0) AS k FROM walk w JOIN ev e ON e.client = w.client AND e.bucket = w.bucket AND e.n = w.n + 1))
SELECT client, bucket, id, t, admitted, retry_after FROM walk""")
def sliding_window_admission(spark, sf_dir):
    """A daily window with small limits; the comparison walks the requests one by one."""
    req = seeded.read_table(spark, sf_dir, "events").selectExpr(
        "user_id AS client", "CASE WHEN event_type = 'purchase' THEN 'upload' ELSE 'default' END AS bucket", "event_id AS id",
        "timestampdiff(MICROSECOND, TIMESTAMP '2024-01-01', ts) / 1000000.0D AS t")
    return V.admission(req, {"upload": 2, "default": 5}, 86400.0)


_STAGE = """st AS (SELECT 'run' || user_id || '_' || strftime(ts, '%j') AS run_id, CASE event_type WHEN 'click' THEN 'extract' WHEN 'view' THEN 'extract' WHEN 'signup' THEN 'validate' WHEN 'purchase' THEN 'validate' ELSE 'error' END AS stage,
 CASE event_type WHEN 'click' THEN 'start' WHEN 'signup' THEN 'start' WHEN 'error' THEN 'failed' ELSE 'end' END AS phase, ts, event_id, 'message ' || event_id AS message FROM events)"""


def _stage(spark, sf_dir):
    return seeded.read_table(spark, sf_dir, "events").selectExpr(
        "concat('run', user_id, '_', date_format(ts, 'DDD')) AS run_id",
        "CASE event_type WHEN 'click' THEN 'extract' WHEN 'view' THEN 'extract' WHEN 'signup' THEN 'validate' WHEN 'purchase' THEN 'validate' ELSE 'error' END AS stage",
        "CASE event_type WHEN 'click' THEN 'start' WHEN 'signup' THEN 'start' WHEN 'error' THEN 'failed' ELSE 'end' END AS phase", "ts", "event_id", "concat('message ', event_id) AS message")


_DUR = """, du0 AS (SELECT *, lag(phase) OVER w AS pp, lag(ts) OVER w AS pt FROM st WHERE phase IN ('start', 'end') WINDOW w AS (PARTITION BY run_id, stage ORDER BY ts, event_id)),
du1 AS (SELECT run_id, stage, arg_max(round_even(date_diff('microsecond', pt, ts) / 1000000.0, 3), (ts, event_id)) AS duration_s, count(*) AS n_runs FROM du0
 WHERE phase = 'end' AND pp = 'start' GROUP BY ALL),
du AS (SELECT run_id, stage, duration_s, coalesce(n_runs, 0) AS n_runs FROM (SELECT DISTINCT run_id, stage FROM st) LEFT JOIN du1 USING (run_id, stage))"""


@query("stage_durations", f"WITH {_STAGE}{_DUR} SELECT * FROM du")
def stage_durations(spark, sf_dir):
    return V.stage_durations(_stage(spark, sf_dir))


@query("run_telemetry_record", f"""WITH {_STAGE}{_DUR}, tt AS (SELECT run_id, round_even(date_diff('microsecond', min(ts), max(ts)) / 1000000.0, 3) AS total_duration_s,
 CASE WHEN bool_or(phase = 'failed') THEN 'failed' ELSE 'success' END AS status, arg_max(message, (ts, event_id)) FILTER (phase = 'failed') AS error_message, substr(arg_max(message, (ts, event_id)) FILTER (phase = 'failed'), 1, 2000) AS error_summary,
 arg_max(stage, (ts, event_id)) FILTER (phase = 'failed') AS error_stage FROM st GROUP BY 1)
SELECT tt.*, (SELECT max(duration_s) FROM du WHERE du.run_id = tt.run_id AND stage = 'extract') AS extract_duration_s,
 (SELECT max(duration_s) FROM du WHERE du.run_id = tt.run_id AND stage = 'validate') AS validate_duration_s FROM tt""")
def run_telemetry_record(spark, sf_dir):
    return V.run_records(_stage(spark, sf_dir), ["extract", "validate"])


_ST = """so AS (SELECT 'run' || user_id || '_' || strftime(ts, '%j') AS run_id, event_id, CASE event_type WHEN 'click' THEN 'extract' WHEN 'view' THEN 'validate' ELSE 'draft' END AS stage,
 CASE event_id % 3 WHEN 0 THEN 'required' WHEN 1 THEN 'required_with_fallback' ELSE 'optional' END AS category, CASE WHEN value > 20 THEN 'error' WHEN value > 15 THEN 'no_work' ELSE 'done' END AS outcome FROM events),
so1 AS (SELECT *, CASE outcome WHEN 'done' THEN 'success' ELSE CASE category WHEN 'required' THEN 'failed' WHEN 'required_with_fallback' THEN 'degraded' ELSE 'skipped' END END AS status FROM so)"""


def _outcomes(spark, sf_dir):
    return V.stage_outcomes(seeded.read_table(spark, sf_dir, "events").selectExpr(
        "concat('run', user_id, '_', date_format(ts, 'DDD')) AS run_id", "event_id", "CASE event_type WHEN 'click' THEN 'extract' WHEN 'view' THEN 'validate' ELSE 'draft' END AS stage",
        "CASE event_id % 3 WHEN 0 THEN 'required' WHEN 1 THEN 'required_with_fallback' ELSE 'optional' END AS category",
        "CASE WHEN value > 20 THEN 'error' WHEN value > 15 THEN 'no_work' ELSE 'done' END AS outcome"))


@query("stage_outcome_by_policy", f"WITH {_ST} SELECT event_id, status FROM so1")
def stage_outcome_by_policy(spark, sf_dir):
    return _outcomes(spark, sf_dir).select("event_id", "status")


@query("run_overall_status", f"WITH {_ST} SELECT run_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status IN ('degraded', 'skipped')) THEN 'degraded' ELSE 'success' END AS overall_status FROM so1 GROUP BY 1")
def run_overall_status(spark, sf_dir):
    return V.overall_status(_outcomes(spark, sf_dir))


@query("stage_metadata_invariants", f"""WITH {_ST}, iv AS (SELECT run_id, stage, CASE WHEN status = 'success' AND event_id % 4 = 0 THEN 'success_without_evidence' WHEN status <> 'success' AND event_id % 5 = 0
 THEN 'unexplained_status' END AS violation FROM so1) SELECT * FROM iv WHERE violation IS NOT NULL""")
def stage_metadata_invariants(spark, sf_dir):
    rows = _outcomes(spark, sf_dir).selectExpr(
        "*", "CASE WHEN event_id % 4 <> 0 THEN map('rules', 50.0D) ELSE map() END AS metadata",
        "CASE WHEN event_id % 5 <> 0 THEN array('note') ELSE array() END AS warnings", "array() AS errors")
    return V.stage_invariants(rows)


_REM = """re AS (SELECT event_id, user_id AS task_id, ['AltText', 'HeadingHierarchy', 'TableStructure', 'FigureCaption', 'LanguageTag', 'MarkInfo', 'PDFUAMetadata', 'ViewerPreferences', 'TabOrder', 'CIDSetRemoval'][event_id % 10 + 1] AS component, ts FROM events)"""


def _remediation(spark, sf_dir):
    names = ", ".join(f"'{c}'" for c in V.COMPONENTS)
    return seeded.read_table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id AS task_id", f"element_at(array({names}), CAST(event_id % 10 AS INT) + 1) AS component", "ts")


@query("remediation_events_by_task", f"WITH {_REM} SELECT task_id, event_id, component, row_number() OVER (PARTITION BY task_id ORDER BY ts, event_id) AS ord, count(*) OVER (PARTITION BY task_id) AS n FROM re")
def remediation_events_by_task(spark, sf_dir):
    return V.task_events(_remediation(spark, sf_dir)).select("task_id", "event_id", "component", "ord", "n")


@query("remediation_events_by_component", f"WITH {_REM} SELECT component, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM re GROUP BY 1")
def remediation_events_by_component(spark, sf_dir):
    return V.events_by_component(_remediation(spark, sf_dir))


@query("bounded_latest_tasks", f"WITH {_REM} SELECT task_id, max(ts) AS last_ts, count(*) AS events FROM re GROUP BY 1 ORDER BY last_ts DESC, task_id LIMIT 20")
def bounded_latest_tasks(spark, sf_dir):
    return V.recent_tasks(_remediation(spark, sf_dir), 20)


@query("stage_duration_histogram", f"""WITH {_STAGE}{_DUR}, bk AS (SELECT unnest([0.5, 1, 2, 5, 10, 30, 60, 120, 300]) AS le), dm AS (SELECT stage, duration_s / 200 AS d FROM du)
SELECT stage, CAST(le AS DOUBLE) AS le, count(d) AS n, count(*) FILTER (d <= le) AS cumulative FROM dm CROSS JOIN bk GROUP BY ALL""")
def stage_duration_histogram(spark, sf_dir):
    return V.duration_histogram(V.stage_durations(_stage(spark, sf_dir)).selectExpr("run_id", "stage", "duration_s / 200 AS duration_s"))


@query("documents_by_status", "SELECT event_type AS status, count(*) AS n, arg_max(value, ts) AS last_score FROM events GROUP BY 1")
def documents_by_status(spark, sf_dir):
    return V.status_counts(seeded.read_table(spark, sf_dir, "events").selectExpr("event_type AS status", "value AS score", "ts"))


@query("tumbling_window_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_window_counts(spark, sf_dir):
    return V.window_counts(seeded.read_table(spark, sf_dir, "events"), "1 hour")


@query("sliding_window_counts", """WITH ho AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS b FROM events)
SELECT b - k * INTERVAL 1 HOUR AS start, b + (2 - k) * INTERVAL 1 HOUR AS "end", event_type, count(*) AS n FROM ho, range(0, 2) t(k) GROUP BY ALL""")
def sliding_window_counts(spark, sf_dir):
    return V.window_counts(seeded.read_table(spark, sf_dir, "events"), "2 hours", "1 hour")


@query("session_window_counts", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events),
h AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM h GROUP BY user_id, k""")
def session_window_counts(spark, sf_dir):
    return V.session_counts(seeded.read_table(spark, sf_dir, "events"), "6 hours")
