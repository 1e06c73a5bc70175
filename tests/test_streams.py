"""Structured Streaming forms over files."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.streaming import journal


def test_journal_stream(spark, tmp_path):
    rows = [(1, 0, "capture-started"), (1, 1, "resource-progress"), (1, 2, "warning"), (1, 3, "encoding"), (1, 4, "capture-succeeded"), (1, 5, "capture-started"), (2, 0, "capture-started"), (2, 0, "capture-started")]
    spark.createDataFrame(rows, "capture_id long, sequence long, type string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("capture_id long, sequence long, type string").parquet(str(tmp_path / "in"))
    q = journal.journal_stream(stream).writeStream.format("memory").queryName("journal_out").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    found = {(r["capture_id"], r["sequence"], r["type"], r["newest_progress"]) for r in spark.table("journal_out").collect()}
    assert found == {(1, 0, "capture-started", -1), (1, 4, "capture-succeeded", 1), (2, 0, "capture-started", -1)}


def test_quiet_sessions_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:05"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 09:00:00")]
    spark.createDataFrame(rows, "k long, t string").select("k", F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, ts timestamp").parquet(str(tmp_path / "in"))
    q = journal.quiet_sessions(stream, "k", "ts", "1 minute", "1 minute").writeStream.outputMode("append").format("memory").queryName("sessions_out").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.table("sessions_out").collect()) == [1, 2]
