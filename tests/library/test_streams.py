"""Streams over several files: what is late is counted, and a restart goes on."""

from __future__ import annotations

from sparkloom.streaming import events


def put(spark, folder, rows):
    df = spark.createDataFrame([(i, f"2024-01-01 {t}", 1, "a", 1.0, "{}") for i, t in rows], "event_id long, ts string, user_id long, event_type string, value double, props string")
    df.withColumn("ts", df.ts.cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(folder)


def test_late_rows_are_counted_and_a_restart_goes_on(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    run = lambda: events.run_once(events.sessions(events.source(spark, source, "*.parquet")), out, check)
    put(spark, source, [(1, "00:00:00"), (2, "00:10:00"), (3, "05:00:00")])
    assert run() == 0
    assert [(r.start.hour, r.n) for r in spark.read.parquet(out).collect()] == [(0, 2)]
    put(spark, source, [(4, "00:20:00"), (5, "05:10:00"), (6, "09:00:00")])  # the first is behind the watermark of 04:00
    assert run() == 1
    assert sorted((r.start.hour, r.n) for r in spark.read.parquet(out).collect()) == [(0, 2), (5, 2)]
