"""The same rules on streams, with state carried from batch to batch."""

from pyspark.sql import functions as F

from pagelight.operators import events
from pagelight.streaming import live

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def run(df, name, tmp_path, mode="append"):
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
         .option("checkpointLocation", str(tmp_path / f"cp_{name}")).start())
    q.awaitTermination(180)
    return df.sparkSession.table(name)


def test_live_admission_matches_batch(spark, tmp_path):
    rows = [(u, "default", i, float(i * 7 + u)) for u in range(3) for i in range(30)]
    schema = "client bigint, bucket string, id bigint, t double"
    src = str(tmp_path / "req")
    for part in range(3):
        chunk = [r for r in rows if r[2] // 10 == part]
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(src)
    stream = live.read_events(spark, src, schema)
    got = {(r["client"], r["id"]): r["admitted"] for r in run(live.live_admission(stream, {"default": 4}), "adm", tmp_path).collect()}
    want = {(r["client"], r["id"]): r["admitted"] for r in events.admission(spark.createDataFrame(rows, schema), {"default": 4}).collect()}
    assert got == want and not all(want.values())


def test_live_admission_sorts_a_trigger_of_several_batches(spark, tmp_path):
    rows = [(1, "default", i, float((i * 37) % 100)) for i in range(100)]
    schema = "client bigint, bucket string, id bigint, t double"
    src = str(tmp_path / "mixed")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = run(live.live_admission(live.read_events(spark, src, schema), {"default": 4}, 20.0), "mixed", tmp_path)
        got = {r["id"]: r["admitted"] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {r["id"]: r["admitted"] for r in events.admission(spark.createDataFrame(rows, schema), {"default": 4}, 20.0).collect()}
    assert got == want and 0 < sum(want.values()) < 100


def progress_of(df, name, tmp_path):
    q = (df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
         .option("checkpointLocation", str(tmp_path / f"cp_{name}")).start())
    assert q.awaitTermination(150), "an availableNow run with timers must end"
    return df.sparkSession.table(name).collect(), q.recentProgress


def test_live_admission_forgets_clients_by_event_time(spark, tmp_path):
    """Clients that come once leave the state a window after the watermark passed; the answers are those of the batch."""
    rows = [(part * 10 + u, "default", part * 1000 + i * 10 + u, 7000 + part * 500.0 + i * 5 + u / 10) for part in range(4) for u in range(5) for i in range(8)]
    rows += [(99, "default", 5000 + i, 7000 + i * 17.0) for i in range(100)]
    schema = "client bigint, bucket string, id bigint, t double"
    src = str(tmp_path / "once")
    for part in range(4):
        spark.createDataFrame([r for r in rows if part * 500 <= r[3] - 7000 < part * 500 + 500], schema).coalesce(1).write.mode("append").parquet(src)
    stream = live.read_events(spark, src, schema)
    found, progress = progress_of(live.live_admission(stream, {"default": 3}, 30.0, "5 seconds"), "once", tmp_path)
    want = events.admission(spark.createDataFrame(rows, schema), {"default": 3}, 30.0).collect()
    assert {(r.client, r.id): r.admitted for r in found} == {(r.client, r.id): r.admitted for r in want}
    assert 0 < sum(r.admitted for r in found) < len(rows)
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress if p["stateOperators"]) == 0
    assert kept[-1] < max(kept) and kept[-1] <= kept[0] + 3, kept


def test_live_stages_forget_starts_by_event_time(spark, tmp_path):
    schema = "run_id string, stage string, phase string, ts timestamp, event_id bigint"
    src = str(tmp_path / "open")
    batches = [[("r", "a", "start", 100, 1), ("r", "b", "start", 100, 2), ("r", "c", "start", 100, 3)],
               [("r", "a", "end", 150, 4), ("q", "a", "start", 400, 5)], [("r", "b", "end", 410, 6), ("q", "a", "end", 450, 7)],
               [("q", "b", "start", 900, 8), ("q", "b", "end", 970, 9)]]
    for part in batches:
        spark.createDataFrame(part, "run_id string, stage string, phase string, t bigint, event_id bigint").selectExpr(
            "run_id", "stage", "phase", "timestamp_seconds(t) AS ts", "event_id").coalesce(1).write.mode("append").parquet(src)
    stream = live.read_events(spark, src, schema)
    found, _ = progress_of(live.live_stage_durations(stream, "10 seconds", 60.0), "open", tmp_path)
    assert sorted(tuple(r) for r in found) == [("q", "a", 50.0), ("r", "a", 50.0)]


def test_live_stages_cross_hours_and_triggers(spark, tmp_path):
    schema = "run_id string, stage string, phase string, ts timestamp, event_id bigint"
    src = str(tmp_path / "stages")
    batches = [[("r", "a", "start", 3590, 1), ("r", "b", "end", 10, 2)], [("r", "a", "end", 3610, 3), ("r", "a", "start", 3620, 4)],
               [("r", "a", "end", 3625, 5), ("r", "a", "end", 3630, 6)]]
    for part in batches:
        spark.createDataFrame(part, "run_id string, stage string, phase string, t bigint, event_id bigint").selectExpr(
            "run_id", "stage", "phase", "timestamp_seconds(t) AS ts", "event_id").coalesce(1).write.mode("append").parquet(src)
    got = run(live.live_stage_durations(live.read_events(spark, src, schema)), "stages", tmp_path).collect()
    assert sorted((r["run_id"], r["stage"], r["duration_s"]) for r in got) == [("r", "a", 5.0), ("r", "a", 20.0)]


def test_live_windows(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    path = str(tmp_path / "ev")
    src.coalesce(1).write.parquet(path)
    got = run(live.live_window_counts(live.read_events(spark, path, EVENTS), "1 hour"), "win", tmp_path, "complete")
    want = events.window_counts(src, "1 hour")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_live_envelopes(spark, tmp_path):
    body = spark.createDataFrame([(1, '{"message":{"data":"eyJhIjoxfQ=="}}'), (2, "{}")], "event_id bigint, body string")
    path = str(tmp_path / "env")
    body.coalesce(1).write.parquet(path)
    got = run(live.live_envelopes(live.read_events(spark, path, "event_id bigint, body string")), "env", tmp_path)
    assert [(r["event_id"], r["payload"]) for r in got.collect()] == [(1, '{"a":1}')]
