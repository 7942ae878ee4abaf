"""Incremental ingestion: versions by batch, duplicates within the watermark, windows on a stream."""

import json

from brindle.streaming import ingest


def test_ingest_versions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = lambda *xs: "\n".join(json.dumps({"id": i, "content": c, "ts": "2024-01-01T00:00:00"}) for i, c in xs)
    (tmp_path / "in/a.json").write_text(rows(("a", "x"), ("b", "y")))
    run = lambda: ingest.start_ingest(ingest.document_stream(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(60)
    run()
    (tmp_path / "in/b.json").write_text(rows(("c", "x"), ("d", "z")))
    run()
    got = ingest.current(spark, str(tmp_path / "t")).collect()
    assert sorted((r["id"], r["access_count"]) for r in got) == [("a", 1), ("b", 0), ("d", 0)]


def test_distinct_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"id": i, "content": "same", "ts": "2024-01-01T00:00:00"}) for i in "ab"))
    stream = ingest.distinct_content(ingest.document_stream(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("distinct_rows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("distinct_rows").count() == 1


def test_windows_on_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"user_id": 1, "event_type": "click", "value": 1.0, "ts": f"2024-01-01T00:00:0{i}"}) for i in range(3)))
    events = spark.readStream.schema("user_id bigint, event_type string, value double, ts timestamp").json(str(tmp_path / "in"))
    q = ingest.rollups(events, "1 minute").writeStream.outputMode("update").format("memory").queryName("rolled").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select max(n) from rolled").first()[0] == 3
